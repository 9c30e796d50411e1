"""A whole run: files to views, views to raw findings, and these to the ordered, distinct findings relation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from sievework.functions import lexing
from sievework.functions.patterns import java
from sievework.operators import findings as R
from sievework.operators.catalog import RULES, Config
from sievework.operators.rules import blocks as B
from sievework.operators.rules import graph as G
from sievework.operators.rules import lines as L
from sievework.operators.rules.manifests import bins, manifest_findings
from sievework.operators.rules.perfile import File, file_findings
from sievework.shared import materialise, spread

_BLOCK = "struct<name string, params string, start_line int, line_count int, body string, code_body string, is_public boolean, is_exported boolean, is_test boolean, has_leading_comment boolean, declaration_line int>"
_FIELDS = f"code string, blocks array<{_BLOCK}>, comments array<struct<kind string, text string, line int, end_line int, start int, end int>>, regions array<struct<name string, start int, end int>>, imports array<struct<specifier string, line int, parents int, type_only boolean>>, bins array<struct<name string, target string, line int>>, found array<struct<rule_id string, line int, message string, symbol string, severity string, metadata_json string>>, diagnostic struct<message string, line int>"


def scan_text(text: str | None, path: str, is_script: bool, config: Config, rules: bool = True) -> dict:
    """Everything that one file yields by itself; without ``rules`` what its lexer yields, without findings."""
    empty = {"code": None, "blocks": [], "comments": [], "regions": [], "imports": [], "bins": [], "found": [], "diagnostic": None}
    if text is None:
        return empty | {"diagnostic": {"message": "the file cannot be read", "line": None}}
    if not is_script:
        named = [dict(zip(("name", "target", "line"), b)) for b in bins(text)] if path.rsplit("/", 1)[-1] == "package.json" else []
        return empty | {"bins": named, "found": manifest_findings(path, text, config)}
    lexed = lexing.Lexed(text)
    blocks, comments = lexing.blocks(lexed), lexed.comments()
    wrong = lexing.delimiter_error(lexed.masked)
    return {
        "code": lexed.masked, "blocks": [asdict(b) for b in blocks], "comments": [asdict(c) for c in comments], "regions": [asdict(r) for r in lexing.regions(lexed, blocks)], "imports": [asdict(i) for i in lexing.imports(lexed)], "bins": [],
        "found": [*manifest_findings(path, text, config), *file_findings(File(path, text, lexed, blocks, comments, config))] if rules else [], "diagnostic": {"message": f"unmatched {wrong[0]}", "line": wrong[1]} if wrong else None,
    }


def scanned(files: DataFrame, config: Config = Config(), rules: bool = True) -> DataFrame:
    """``files`` (repo, file_path, is_script, text; mode and delivery if there are any) with masked code, blocks, comments,
    regions, imports and the findings of rules that need a whole file. One Arrow pass where the files are read."""
    kept = ["repo", "file_path", "is_script", "text", *[c for c in ("mode", "delivery") if c in files.columns]]
    slim = spread(files.select(*kept), "repo", "file_path")
    fields = _parse_datatype_string(_FIELDS)
    schema = StructType([*slim.schema.fields, *fields.fields])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = [scan_text(text, path or "", bool(script), config, rules) for _, path, script, text in zip(*columns[:4])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[f.name] for r in rows], type=f.type) for f in arrow)], names=[*kept, *arrow.names])

    return slim.mapInArrow(run, schema)


def lines_of(scan: DataFrame, scripts_only: bool) -> DataFrame:
    """Lines with their masked counterparts, numbered from 1."""
    rows = scan.where("is_script") if scripts_only else scan
    split = lambda c: F.split(c, r"\r?\n", -1)
    pairs = F.arrays_zip(split("text").alias("line"), split("code").alias("code")) if scripts_only else F.transform(split("text"), lambda x: F.struct(x.alias("line"), F.lit(None).cast("string").alias("code")))
    exploded = rows.where(F.col("text").isNotNull()).select("repo", "file_path", F.posexplode(pairs).alias("_i", "_p"))
    return exploded.select("repo", "file_path", (F.col("_i") + 1).alias("n"), F.col("_p.line").alias("line"), F.col("_p.code").alias("code"))


# What one pass over the files leaves behind, in a narrow table: findings, and facts that rules across files look at.
_KEPT = "array<struct<kind:string,rule_id:string,line:int,symbol:string,message:string,severity:string,metadata_json:string,a:string,b:string,n:int,flag:boolean>>"
_KEPT_FIELDS = {"kind": "string", "rule_id": "string", "line": "int", "symbol": "string", "message": "string", "severity": "string", "metadata_json": "string", "a": "string", "b": "string", "n": "int", "flag": "boolean"}


def _kept(kind: str, **values: Column) -> Column:
    made = values | {"kind": F.lit(kind)}
    return F.struct(*[(made[c] if c in made else F.lit(None)).cast(t).alias(c) for c, t in _KEPT_FIELDS.items()])


def _findings(yields: Column, seq: int) -> Column:
    return F.transform(yields, lambda y: _kept("finding", **{c: y[c] for c in ("rule_id", "line", "symbol", "message", "severity", "metadata_json")}, n=F.lit(seq)))


def kept_rows(files: DataFrame, config: Config = Config()) -> DataFrame:
    """Findings of all rules on single files, lines and blocks, and the facts for those across files: one row each, with
    repo, file_path (and delivery, if there is one). Texts flow through this one pass and are neither written nor moved."""
    scan = scanned(files, config)
    keys = ["repo", "file_path", *(["delivery"] if "delivery" in files.columns else [])]
    text = F.col("text")
    script = F.col("is_script") & text.isNotNull()
    n_lines = F.regexp_count(text, F.lit("\n")) + 1
    exported = java(G.EXPORTED)
    front = F.regexp_extract(text, f"([\\s\\S]*?){exported}", 1)
    has_export = script & text.rlike(exported)
    own_file = _kept("file", n=n_lines, a=F.when(has_export, F.regexp_extract(text, exported, 1)), line=F.when(has_export, F.length(front) - F.length(F.replace(front, F.lit("\n"), F.lit(""))) + 1), flag=script, b=F.col("mode") if "mode" in files.columns else F.lit(None))
    quoting = F.filter("comments", lambda c: c["text"].rlike(G.QUOTED_PATH) & ~c["text"].rlike(java(G.HISTORY)))
    rest = F.concat(
        _findings(F.col("found"), 0), _findings(L.length_yields(config), 1), F.array(own_file),
        F.transform("imports", lambda i: _kept("import", a=i["specifier"], line=i["line"], n=i["parents"], flag=i["type_only"])), F.transform(quoting, lambda c: _kept("comment", a=c["text"], line=c["line"])),
        F.transform("bins", lambda x: _kept("bin", a=x["name"], b=x["target"], line=x["line"])), F.transform("regions", lambda r: _kept("region", a=r["name"], line=r["start"], n=r["end"])),
    )
    none, nothing, no_block = F.lit(None), F.array().cast(_KEPT), F.lit(None).cast(_BLOCK.replace(" ", ":").replace(",:", ","))
    item = lambda n, line, code, block, kept: F.struct(n.cast("int").alias("n"), line.cast("string").alias("line"), code.cast("string").alias("code"), block.alias("block"), kept.alias("kept"))
    split = lambda c: F.split(c, r"\r?\n", -1)
    code = F.when(script, split("code"))
    lines = F.transform(split("text"), lambda x, i: item(i + 1, x, F.get(code, i), no_block, nothing))
    items = F.concat(F.array(item(none, none, none, no_block, rest)), F.coalesce(lines, F.array().cast(f"array<struct<n:int,line:string,code:string,block:{_BLOCK.replace(' ', ':').replace(',:', ',')},kept:{_KEPT}>>")), F.transform("blocks", lambda b: item(none, none, none, b, nothing)))
    flat = B.prepared(scan.select(*keys, F.inline(items)).select(*keys, "n", "line", "code", "kept", "block.*"))
    of_line = F.when(F.col("line").isNotNull(), F.concat(F.when(F.col("code").isNotNull(), _findings(L.line_yields(config), 2)).otherwise(nothing), _findings(L.secret_yields(config), 3))).otherwise(nothing)
    of_block = F.when(F.col("body").isNotNull(), _findings(B.block_yields(config), 4)).otherwise(nothing)
    return flat.select(*keys, F.inline(F.concat("kept", of_line, of_block)))


def raw_findings(files: DataFrame, config: Config = Config(), stale: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(all rules' findings as they come, regions of declarations). ``stale`` names deliveries (repo, file_path, delivery)
    that others have replaced; they drop out here, where rows are narrow."""
    kept = materialise(kept_rows(files, config), "kept", by="kind")
    if stale is not None:
        kept = kept.join(stale.select("repo", "file_path", "delivery"), ["repo", "file_path", "delivery"], "left_anti")
    of = lambda kind: kept.where(F.col("kind") == kind)
    imports = of("import").select("repo", "file_path", F.col("a").alias("specifier"), "line", F.col("n").alias("parents"), F.col("flag").alias("type_only"))
    known = of("file").select("repo", "file_path", "n", F.col("a").alias("symbol"), "line", F.col("flag").alias("is_script"), F.col("b").cast("int").alias("mode"))
    edge = materialise(G.edges(imports, known.where("is_script").select("repo", "file_path").distinct()), "edges")
    bins = of("bin").select("repo", "file_path", F.col("a").alias("name"), F.col("b").alias("target"), "line")
    comments = of("comment").select("repo", "file_path", F.col("a").alias("text"), "line")
    out = of("finding").select("repo", "file_path", "rule_id", "line", "symbol", "message", "severity", "metadata_json", F.col("n").alias("emit_seq"))
    across = [G.deep_imports(imports, config), G.cycle_findings(edge), G.concentration(known, config), G.missing_tests(known, edge), G.bin_findings(bins, known), G.stale_paths(comments, known)]
    for i, part in enumerate(across, 5):
        out = out.unionByName(part.withColumn("emit_seq", F.lit(i)))
    regions = of("region").select("repo", "file_path", F.col("a").alias("name"), F.col("line").alias("start"), F.col("n").alias("end"))
    return R.enabled(out, sorted(config.disabled)), regions


def analyse(files: DataFrame, config: Config = Config(), baseline: DataFrame | None = None, ranges: DataFrame | None = None, whole_files: DataFrame | None = None, scope: str = "symbol", stale: DataFrame | None = None) -> DataFrame:
    """The findings of a run: rules, then order and distinct-on, then the changed regions, then the baseline.

    ``files``: repo, file_path, is_script, text, mode, and delivery if one path can come several times, of which ``stale``
    names those that others have replaced. Files without text yield a diagnostic (see :func:`diagnostics`) and no findings.
    ``ranges`` and ``whole_files`` are the changed lines and new files; with the scope "symbol" a finding also counts if the
    declaration around it has changed, with "hunk" its own lines have to. ``config.severities`` act on all rules.
    """
    spark = files.sparkSession
    catalog = spark.createDataFrame([(r.rule_id, r.pillar, config.severities.get(r.rule_id, r.severity), r.confidence, r.remediation) for r in RULES.values()], "rule_id string, pillar string, _severity string, confidence string, remediation string")
    raw, regions = raw_findings(files, config, stale)
    raw = raw.join(F.broadcast(catalog), "rule_id")  # the catalogue is fixed
    found = R.with_fingerprint(raw.withColumn("severity", F.coalesce("severity", "_severity")).drop("_severity"))
    found = R.distinct_findings(found, ["repo"])
    if ranges is not None:
        found = R.in_scope(materialise(found, "findings"), ranges, whole_files, regions if scope == "symbol" else None)
    if baseline is not None:
        found = R.not_in_baseline(found, baseline)
    return found


def diagnostics(files: DataFrame, config: Config = Config()) -> DataFrame:
    """Files that cannot be read, and brackets that close what is not open."""
    rows = scanned(files, config, rules=False).where(F.col("diagnostic").isNotNull())
    return rows.select("repo", "file_path", "diagnostic.message", "diagnostic.line")
