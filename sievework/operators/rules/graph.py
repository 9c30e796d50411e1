"""Rules across files: imports as edges, cycles, concentration of code, missing tests, targets of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.functions.patterns import java
from sievework.operators.catalog import Config
from sievework.shared import materialise

# The extensions an import may leave out, in their order, and the paths of tests, declarations and fixtures.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
TEST = r"(?:^|/)(?:__tests__|tests?|spec)/|\.(?:test|spec)\.[cm]?[tj]sx?$"
NO_PRODUCTION = r"\.d\.[cm]?ts$|(?:^|/)(?:__fixtures__|fixtures?|testdata|generated)/"
EXPORTED = r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
QUOTED_PATH = r"[`'\"]((?:\.{1,2}/|src/|bin/|scripts/|docs/|fixtures/)[A-Za-z0-9_./-]+\.(?:ts|tsx|js|json|ya?ml|toml|md|sh))[`'\"]"
HISTORY = r"(?i)\b(?:previously|legacy|compat|migration|ADR)\b"
LONGEST_CYCLE = 12


def production(path: Column) -> Column:
    """Whether a path is that of code that is neither test, declaration, fixture nor generated."""
    return ~path.rlike(TEST) & ~path.rlike(NO_PRODUCTION)


def _rows(df: DataFrame, rule_id: str, message: str, line: Column, symbol: Column, metadata: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select("repo", F.col("file_path"), F.lit(rule_id).alias("rule_id"), line.cast("int").alias("line"), symbol.cast("string").alias("symbol"), F.lit(message).alias("message"), none.alias("severity"), (none if metadata is None else metadata).alias("metadata_json"))


def edges(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Relative imports resolved to files: one with an extension as it stands or with another extension, one without with
    an extension or as a folder's index file; the first that exists counts. ``imports``: repo, file_path, specifier, line, parents, type_only; ``paths``: repo, file_path.

    An equi join on the path, so it is spread by the many paths of a repository and not by its name.
    """
    raw = F.when(F.col("file_path").contains("/"), F.concat(S.dir_name(F.col("file_path")), F.lit("/"), F.col("specifier"))).otherwise(F.col("specifier"))
    base = imports.withColumn("base", S.collapsed(raw))
    stem = F.regexp_replace("base", r"\.[^./]+$", "")
    plain = stem == F.col("base")
    with_extension = [F.concat(stem, F.lit(f".{e}")) for e in EXTENSIONS]
    as_folder = [x for e in EXTENSIONS for x in (F.concat(F.col("base"), F.lit(f".{e}")), F.concat(F.col("base"), F.lit(f"/index.{e}")))]
    options = F.when(plain, F.array(*as_folder)).otherwise(F.array(F.col("base"), *with_extension))
    tried = base.select("repo", F.col("file_path").alias("src"), "specifier", "line", "type_only", F.posexplode(options).alias("rank", "file_path"))
    hit = tried.join(paths.select("repo", "file_path"), ["repo", "file_path"])
    best = hit.groupBy("repo", "src", "specifier", "line", "type_only").agg(F.min_by("file_path", "rank").alias("dst"))
    return best.select("repo", "src", "dst", "specifier", "line", "type_only")


def deep_imports(imports: DataFrame, config: Config) -> DataFrame:
    rows = imports.where(F.col("parents") > config.threshold("design.deep-relative-import"))
    return _rows(rows, "design.deep-relative-import", "An import climbs many folders.", F.col("line"), F.col("specifier"))


def cycles(edge: DataFrame, longest: int = LONGEST_CYCLE) -> DataFrame:
    """Import cycles of at most ``longest`` files, each once: (repo, files in order of their names).

    Only edges that can lie on a cycle take part: those whose target leads back to their source within the steps that are
    left. Paths start at the smallest of their files, grow by one join
    per step and only to files that can still get back in time, so that a path without a cycle is given up as soon as that is
    known and a cycle is found once; each step is written, which keeps the plans short.
    """
    own = materialise(edge.where(~F.col("type_only") & (F.col("src") != F.col("dst"))).select("repo", "src", "dst").distinct(), "import-edges")
    for _ in range(longest):
        before = own.count()
        left = own.join(own.select("repo", F.col("dst").alias("src")).distinct(), ["repo", "src"], "left_semi")
        left = left.join(left.select("repo", F.col("src").alias("dst")).distinct(), ["repo", "dst"], "left_semi").select("repo", "src", "dst")
        own = materialise(left, "import-core")
        after = own.count()
        if after == 0:
            return own.sparkSession.createDataFrame([], "repo string, files array<string>")
        if after == before:
            break
    back = _distances(own, longest)
    paths = own.where("dst > src").select("repo", F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("files"))
    closed = None
    for steps in range(2, longest + 1):
        # a path of this many files has to get back within the steps that are left
        paths = paths.join(back.where(F.col("steps") <= longest - steps + 1), ["repo", "last", "first"], "left_semi")
        paths = materialise(paths.select("repo", "first", "last", "files"), "import-paths")
        if paths.isEmpty():
            break
        found = paths.join(back.where("steps = 1"), ["repo", "last", "first"], "left_semi").select("repo", F.array_sort("files").alias("files"))
        closed = found if closed is None else closed.unionByName(found)
        step = own.select("repo", F.col("src").alias("last"), F.col("dst").alias("next"))
        grown = paths.join(step, ["repo", "last"]).where((F.col("next") > F.col("first")) & ~F.array_contains("files", F.col("next")))
        paths = grown.select("repo", "first", F.col("next").alias("last"), F.array_append("files", F.col("next")).alias("files"))
    if closed is None:
        return own.sparkSession.createDataFrame([], "repo string, files array<string>")
    return closed.distinct()


def _distances(edge: DataFrame, longest: int) -> DataFrame:
    """(repo, last, first, steps): from which files which smaller file is reached, and in how few steps at least, over files
    that are not smaller than it. Walks backwards from each file and meets every pair once, so that its size is bounded by the
    pairs within one component and not by the paths between them."""
    seen = materialise(edge.where("src > dst").select("repo", F.col("src").alias("last"), F.col("dst").alias("first"), F.lit(1).alias("steps")), "import-reach")
    fresh = seen
    for steps in range(2, longest):
        before = edge.select("repo", F.col("src").alias("earlier"), F.col("dst").alias("last"))
        reached = fresh.join(before, ["repo", "last"]).where("earlier > first").select("repo", F.col("earlier").alias("last"), "first").distinct()
        fresh = materialise(reached.join(seen, ["repo", "last", "first"], "left_anti").withColumn("steps", F.lit(steps)), "import-reach")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen


def cycle_findings(edge: DataFrame) -> DataFrame:
    """A finding per cycle, at the first import by which its first file joins it."""
    found = cycles(edge).withColumn("file_path", F.element_at("files", 1))
    inside = edge.where(~F.col("type_only")).select("repo", F.col("src").alias("file_path"), "dst", F.col("line").alias("_line"))
    placed = found.join(inside, ["repo", "file_path"]).where(F.array_contains("files", F.col("dst")))
    rows = placed.groupBy("repo", "file_path", "files").agg(F.min("_line").alias("_line"))
    return _rows(rows, "design.circular-import", "Files import each other in a circle.", F.col("_line"), F.array_join("files", " -> "))


def concentration(files: DataFrame, config: Config) -> DataFrame:
    """The largest script of each repository if it holds more than the threshold of its lines, in per cent. ``files``: repo,
    file_path, is_script, n (lines)."""
    lines = files.where(F.col("is_script") & production(F.col("file_path"))).select("repo", "file_path", "n")
    # of equally large files the one with the first path holds
    largest = F.min(F.struct((-F.col("n")).alias("_n"), "file_path"))
    total = lines.groupBy("repo").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("files"), F.max("n").alias("n"), largest.alias("_largest"))
    share = F.floor(F.col("n") * 1000 / F.col("total") + 0.5) / 10
    least = {k: config.option("design.large-module-concentration", k) for k in ("minFiles", "minLines")}
    rows = total.withColumn("file_path", F.col("_largest.file_path")).where((F.col("files") >= least["minFiles"]) & (F.col("n") >= least["minLines"]) & (share > config.threshold("design.large-module-concentration")))
    return _rows(rows, "design.large-module-concentration", "One file holds most of the code.", F.lit(1), S.file_stem(F.col("file_path")), F.to_json(F.struct(share.alias("share"))))


def missing_tests(files: DataFrame, edge: DataFrame) -> DataFrame:
    """Scripts with an export that no test beside them and no import from a test covers: two anti joins. ``files``: repo,
    file_path, is_script, symbol and line (of the first export, null without one)."""
    paths = files.where(F.col("is_script"))
    base = F.regexp_replace("file_path", r"\.[cm]?[tj]sx?$", "")
    folder = F.when(S.dir_name(F.col("file_path")) == ".", F.lit("")).otherwise(S.dir_name(F.col("file_path")))
    below = lambda name: F.when(folder == "", F.lit(name)).otherwise(F.concat(folder, F.lit(f"/{name}")))
    # a test covers files of its name in its folder and above it; one in a top folder covers files everywhere
    tests = paths.where(F.col("file_path").rlike(TEST)).select("repo", S.base_name(F.regexp_replace(base, r"\.(?:test|spec)$", "")).alias("name"), F.when(F.col("file_path").rlike("^tests?/"), F.lit("*")).otherwise(folder).alias("at")).distinct()
    open_files = paths.where(production(F.col("file_path")) & F.col("symbol").isNotNull()).select("repo", "file_path", S.base_name(base).alias("name"), "symbol", "line", F.explode(F.array(folder, below("__tests__"), below("tests"), F.lit("*"))).alias("at"))
    covered = open_files.join(tests, ["repo", "name", "at"], "left_semi").select("repo", "file_path").distinct()
    imported = edge.where(F.col("src").rlike(TEST)).select("repo", F.col("dst").alias("file_path")).distinct()
    rows = open_files.where("at = '*'").join(covered.unionByName(imported), ["repo", "file_path"], "left_anti")
    return _rows(rows, "test-quality.missing-nearby-test", "No test covers the file.", F.col("line"), F.col("symbol"))


def bin_findings(bins: DataFrame, files: DataFrame) -> DataFrame:
    """Executables of manifests that do not exist, or that may not be executed. ``bins``: repo, file_path, name, target,
    line; ``files``: repo, file_path, mode."""
    folder = S.dir_name(F.col("file_path"))
    target = S.collapsed(F.when(folder == ".", F.col("target")).otherwise(F.concat(folder, F.lit("/"), F.col("target"))))
    wanted = bins.withColumn("at", target)
    listing = files.select("repo", F.col("file_path").alias("at"), "mode").distinct()
    missing = wanted.join(listing.select("repo", "at").distinct(), ["repo", "at"], "left_anti")
    plain = wanted.join(listing, ["repo", "at"]).where(F.col("mode").isNotNull() & (F.col("mode").bitwiseAND(F.lit(0o111)) == 0))
    return _rows(missing, "design.package-bin-missing", "A manifest names a file that does not exist.", F.col("line"), F.col("name")).unionByName(_rows(plain, "design.package-bin-not-executable", "A manifest names a file that cannot be executed.", F.col("line"), F.col("name")))


def stale_paths(comments: DataFrame, paths: DataFrame) -> DataFrame:
    """Comments that quote a path which exists neither below the root nor beside the file: an anti join on the path.
    Comments that speak of the past are left alone. ``comments``: repo, file_path, text, line."""
    quoted = F.regexp_extract_all("text", F.lit(QUOTED_PATH), F.lit(1))
    told = comments.where(~F.col("text").rlike(java(HISTORY))).select("repo", "file_path", "line", F.explode(quoted).alias("quoted"))
    folder = S.dir_name(F.col("file_path"))
    beside = F.when(folder == ".", F.col("quoted")).otherwise(F.concat(folder, F.lit("/"), F.col("quoted")))
    tried = told.select("*", F.explode(F.array_distinct(F.array(S.collapsed(F.col("quoted")), S.collapsed(beside)))).alias("at"))
    known = paths.select("repo", F.col("file_path").alias("at"), F.lit(True).alias("_there")).distinct()
    found = tried.join(known, ["repo", "at"], "left").groupBy("repo", "file_path", "line", "quoted").agg(F.max("_there").alias("_there"))
    return _rows(found.where(F.col("_there").isNull()), "docs.stale-comment", "The comment names a path that does not exist.", F.col("line"), F.lit(None), F.to_json(F.struct(F.col("quoted").alias("reference"))))
