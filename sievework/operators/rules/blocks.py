"""Rules on callable blocks: metrics and shapes as built-in column expressions over one row per block.

Names in upper case hold patterns, which are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.patterns import java
from sievework.operators.catalog import Config
from sievework.operators.rules.lines import YIELD

TEST_PATH = r"(?:^|/)(?:__tests__|tests?|spec|__fixtures__|fixtures?|testdata)/|\.(?:test|spec)\.[cm]?[tj]sx?$"
BROAD_TEST_PATH = r"(?:^|/)test/(?:integration|contract|smoke|performance)/"
NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
BRANCH = r"\b(?:if|switch|case|for|while|catch)\b|\?|&&|\|\|"
ASSERTION = r"\bassert(?:\.[A-Za-z]+|[A-Z][A-Za-z0-9_$]*)?\s*\(|\bexpect(?:\.(?:assertions|hasAssertions)|[A-Z][A-Za-z0-9_$]*)?\s*\(|\b[A-Za-z_$][A-Za-z0-9_$]*Check\s*\(|\.(?:rejects|resolves)\b|\b(?:doesNotReject|rejects)\s*\("
SLEEP = r"\b(?:setTimeout|sleep|waitForTimeout)\s*\("
FOCUS = r"\.(?:only|skip)\s*\("
ERROR_TYPE = r"\.toThrow\s*\(\s*(?:Error|[A-Z][A-Za-z0-9_$]*Error)\s*\)|\bassert\.throws\s*\([^,\n]+,\s*(?:Error|[A-Z][A-Za-z0-9_$]*Error)\s*\)"
GLOBAL_STATE = r"\bprocess\.env\.[A-Za-z0-9_]+\s*=|\bglobalThis\.[A-Za-z0-9_$]+\s*=|\b(?:Date\.now|Math\.random)\s*="
ALWAYS_TRUE = r"\bassert\.ok\s*\(\s*true\s*\)"
ASSERT_PAIR = r"\bassert\.(?:equal|strictEqual|deepEqual)\s*\(\s*([^,\n]+?)\s*,\s*([^,\n)]+?)(?:\s*,|\s*\))"
EXPECT_PAIR = r"\bexpect\s*\(\s*([^)]+?)\s*\)\s*\.\s*to(?:Be|Equal|StrictEqual)\s*\(\s*([^)]+?)\s*\)"
SNAPSHOT = r"\.\s*toMatch(?:Inline)?Snapshot\s*\("
SNAPSHOT_ASSERTION = r"\bexpect\s*\([\s\S]*?\)\s*\.\s*toMatch(?:Inline)?Snapshot\s*\([^)]*\)\s*;?"
NO_THROW = r"\bassert\.doesNotThrow\s*\(|\.\s*not\s*\.\s*toThrow\s*\("
NO_THROW_ASSERTIONS = (r"\bassert\.doesNotThrow\s*\([\s\S]*?\)\s*;?", r"\bexpect\s*\([\s\S]*?\)\s*\.\s*not\s*\.\s*toThrow\s*\([^)]*\)\s*;?")
COUNTED_ASSERTIONS = r"\bexpect\.(?:assertions|hasAssertions)\s*\([^)]*\)\s*;?"
MOCK_MADE = r"\b(?:vi|jest)\.fn\s*\(|\b(?:createMock|mock|sinon\.stub)\s*\("
MOCK_ASSERTED = r"\.(?:toHaveBeenCalled|toHaveBeenCalledWith|toHaveBeenNthCalledWith|toBeCalled|toBeCalledWith)\s*\("
MOCK_DECLARED = rf"\bconst\s+({NAME})\s*=\s*(?:(?:vi|jest)\.fn|sinon\.stub|createMock|mock)\s*\("
EXPECTED_NAME = rf"\bexpect\s*\(\s*({NAME})\s*\)"
EXPECT_NUMBER = r"\bexpect\s*\(\s*([^)]+?)\s*\)\s*\.\s*to(?:Be|Equal)\s*\(\s*(-?\d+(?:\.\d+)?)\s*\)"
ASSERT_NUMBER = r"\bassert\.(?:equal|strictEqual|deepEqual)\s*\(\s*([^,\n]+?)\s*,\s*(-?\d+(?:\.\d+)?)(?:\s*,|\s*\))"
CONTRACT_TEST = r"(?i)\b(?:constant|threshold|limit|budget|default|contract)\b"
STUB_REASON = r"(?i)\b(?:intentional no-op|test double|stub|fake|interface contract)\b"
RETURNED = rf"\b(?:const|let)\s+({NAME})\s*=\s*[^;]+;\s*return\s+\1\s*;"
# The same with what stands in front of it, from the end of the last match on.
FRONT_AND_RETURNED = rf"\G([\s\S]*?)\b(?:const|let)\s+({NAME})\s*=\s*[^;]+;\s*return\s+\2\s*;"


def cyclomatic(code: Column) -> Column:
    return F.regexp_count(code, F.lit(java(BRANCH))) + 1


def nesting(code: Column) -> Column:
    """Deepest brace less one; a brace that closes nothing counts for nothing."""
    depth = F.aggregate(
        F.split(F.regexp_replace(code, r"[^{}]", ""), ""),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
        lambda s, c: F.when(c == "{", F.struct((s["d"] + 1).alias("d"), F.greatest(s["m"], s["d"] + 1).alias("m"))).when(c == "}", F.struct(F.greatest(s["d"] - 1, F.lit(0)).alias("d"), s["m"].alias("m"))).otherwise(s),
        lambda s: s["m"],
    )
    return F.greatest(depth - 1, F.lit(0))


def parameter_count(params: Column) -> Column:
    return F.size(F.filter(F.split(params, ","), lambda p: F.trim(p) != ""))


def parameter_names(params: Column) -> Column:
    """Plain parameter names, without modifier and dots; destructured ones are left out."""
    bare = lambda p: F.regexp_replace(F.regexp_replace(_bare(p), java(r"^(?:public|private|protected|readonly)\s+"), ""), r"^\.\.\.", "")
    return F.filter(F.transform(F.split(params, ","), lambda p: _bare(F.split(bare(p), "[?:=]")[0])), lambda n: n.rlike(f"^{NAME}$"))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, java(r"^\s+|\s+$"), "")


def function_body(code: Column) -> Column:
    """What stands between the outermost braces, or behind the arrow of an expression."""
    low, high = F.locate("{", code), F.length(code) - F.locate("}", F.reverse(code)) + 1
    arrow = F.locate("=>", code)
    braced = (low > 0) & (F.locate("}", code) > 0) & (high > low)
    return F.when(braced, F.substring(code, low + 1, high - low - 1)).when(arrow > 0, F.regexp_replace(F.substring(code, arrow + 2, F.length(code)), java(r";?\s*$"), "")).otherwise("")


def setup_lines(body: Column) -> Column:
    """Lines of a test before its first assertion, without blank ones and closing braces."""
    lines = F.filter(F.transform(F.split(body, "\n"), _bare), lambda x: ~x.isin("", "}", "});"))
    first = F.array_position(F.transform(lines, lambda x: x.rlike(java(ASSERTION))), F.lit(True))
    return F.when(first > 0, first - 1).otherwise(F.size(lines))


def _pairs(code: Column, pattern: str) -> Column:
    """The two groups of all matches as an array of structs."""
    group = lambda i: F.regexp_extract_all(code, F.lit(java(pattern)), F.lit(i))
    return F.arrays_zip(group(1).alias("a"), group(2).alias("b"))


def _without(code: Column, *patterns: str) -> Column:
    for p in patterns:
        code = F.regexp_replace(code, java(p), "")
    return code


def _offsets(code: Column, pattern: str) -> Column:
    """(line within the block, second group) of all matches of a pattern whose first group is what stands in front."""
    part = lambda i: F.regexp_extract_all(code, F.lit(java(pattern)), F.lit(i))
    lines = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    matches = F.arrays_zip(part(0).alias("all"), part(1).alias("front"), part(2).alias("name"))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<line:int,name:string>>").alias("out"))
    return F.aggregate(matches, start, lambda s, m: F.struct((s["n"] + lines(m["all"])).alias("n"), F.array_append(s["out"], F.struct((s["n"] + lines(m["front"])).alias("line"), m["name"].alias("name"))).alias("out")), lambda s: s["out"])


def prepared(blocks: DataFrame) -> DataFrame:
    """Blocks with what several rules look at. A null name, flag or comment mark counts as empty or false, and a block whose
    code is unknown is told by its body."""
    false = F.lit(False)
    b = blocks.withColumns({"block_code": F.coalesce("code_body", "body"), "is_test": F.coalesce("is_test", false), "commented": F.coalesce("has_leading_comment", false), "exported": F.coalesce("is_exported", false), "par": F.coalesce("params", F.lit("")), "title": F.coalesce("name", F.lit(""))})
    code = F.col("block_code")
    b = b.withColumns({"cyclo": cyclomatic(code), "deep": nesting(code), "n_params": parameter_count(F.col("par")), "inner": function_body(code)})
    return b.withColumns({"setup": F.when(F.col("is_test"), setup_lines(F.col("inner"))), "cognitive": F.col("cyclo") + F.col("deep")})


def block_findings(blocks: DataFrame, config: Config = Config()) -> DataFrame:
    """Findings of all block rules in one pass over the blocks.

    ``blocks``: repo, file_path, name, params, start_line, line_count, body, code_body, is_public, is_exported, is_test,
    has_leading_comment, declaration_line. Nothing is shuffled; blocks without body give nothing.
    """
    return prepared(blocks.where(F.col("body").isNotNull())).select("repo", "file_path", F.inline(block_yields(config)))


def block_yields(config: Config = Config()) -> Column:
    """What all block rules yield for one block as :func:`prepared` gives it."""
    false = F.lit(False)
    code, body, title = F.col("block_code"), F.col("body"), F.col("title")
    inner, test = F.col("inner"), F.col("is_test")
    limit = config.threshold
    has = lambda p, c=code: c.rlike(java(p))
    in_tests = F.coalesce(F.col("file_path").rlike(TEST_PATH), false)
    declared = F.coalesce(F.col("file_path").endswith(".d.ts"), false)
    shown = F.filter(F.transform(F.split(code, "\n"), _bare), lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("/*") & ~x.startswith("*"))
    signature = F.coalesce(F.try_element_at(shown, F.lit(1)).rlike(java(r"\)[^{;]*;\s*$")), false)
    empty = _bare(F.regexp_replace(F.regexp_replace(inner, r"(?m)//.*$", ""), r"/\*[\s\S]*?\*/", "")) == ""
    stub = in_tests & body.rlike(r"//|/\*") & has(STUB_REASON, body)
    squeeze = lambda x: F.regexp_replace(_bare(x), ";$", "")
    same = lambda p: F.exists(_pairs(code, p), lambda x: squeeze(x["a"]) == squeeze(x["b"]))
    number = lambda p: F.exists(_pairs(code, p), lambda x: _magic(x["a"], x["b"].cast("double")))
    expected = F.regexp_extract_all(code, F.lit(java(EXPECTED_NAME)), F.lit(1))
    unmocked = F.filter(expected, lambda t: ~t.rlike("(?i)(?:mock|stub|spy)$"))
    broad = F.coalesce(F.col("file_path").rlike(BROAD_TEST_PATH), false)
    most_setup = F.when(broad, 2 * limit("test-quality.setup-bloat")).otherwise(limit("test-quality.setup-bloat"))
    rules = [
        ("size.function-length", F.col("line_count") > limit("size.function-length"), "The function is long.", "line_count"),
        ("size.parameter-count", F.col("n_params") > limit("size.parameter-count"), "The function takes many parameters.", "n_params"),
        ("complexity.cyclomatic", F.col("cyclo") > limit("complexity.cyclomatic"), "Many paths lead through the function.", "cyclo"),
        ("complexity.cognitive", F.col("cognitive") > limit("complexity.cognitive"), "The function is hard to follow.", "cognitive"),
        ("naming.generic-function", F.lower(title).isin(sorted(config.banned_generic_names)), "The function's name says nothing.", None),
        ("docs.missing-exported-function-doc", ~test & F.col("exported") & ~F.col("commented"), "An exported function has no comment.", None),
        ("docs.missing-internal-function-doc", ~test & ~F.col("exported") & ~F.col("commented"), "A function has no comment.", None),
        ("waste.empty-function", empty & ~declared & ~signature & ~stub, "The function does nothing.", None),
        ("test-quality.no-assertions", test & ~has(ASSERTION), "The test asserts nothing.", None),
        ("test-quality.trivial-assertion", test & (has(ALWAYS_TRUE) | same(ASSERT_PAIR) | same(EXPECT_PAIR)), "The assertion cannot fail.", None),
        ("test-quality.snapshot-only-test", test & has(SNAPSHOT) & ~has(ASSERTION, _without(code, SNAPSHOT_ASSERTION, COUNTED_ASSERTIONS)), "Only a snapshot is asserted.", None),
        ("test-quality.no-throw-only-test", test & has(NO_THROW) & ~has(ASSERTION, _without(code, *NO_THROW_ASSERTIONS, COUNTED_ASSERTIONS)), "Only the absence of an error is asserted.", None),
        ("test-quality.exception-type-only", test & has(ERROR_TYPE), "Only the type of an error is asserted.", None),
        ("test-quality.magic-number-assertion", test & (number(EXPECT_NUMBER) | number(ASSERT_NUMBER)) & ~has(CONTRACT_TEST, title), "A bare number is expected.", None),
        ("test-quality.mock-only-test", test & has(MOCK_MADE) & has(MOCK_ASSERTED) & (F.size(expected) > 0) & (F.size(unmocked) == 0), "Only mocks are asserted.", None),
        ("test-quality.global-state-mutation", test & has(GLOBAL_STATE), "The test changes global state.", None),
        ("test-quality.setup-bloat", test & (F.col("setup") > most_setup), "Much is set up before the first assertion.", "setup"),
        ("test-quality.sleep-in-test", test & has(SLEEP), "The test sleeps.", None),
        ("test-quality.only-skip", test & has(FOCUS), "A test is focused or skipped.", None),
    ]
    none = F.lit(None).cast("string")
    row = lambda rule_id, line, symbol, message, data: F.struct(F.lit(rule_id).alias("rule_id"), line.cast("int").alias("line"), symbol.alias("symbol"), message.alias("message"), none.alias("severity"), data.alias("metadata_json"))
    start, name = F.col("start_line"), F.col("name")
    parts = [F.array_compact(F.array(*[F.when(F.coalesce(hit, false), row(rule_id, start, name, F.lit(message), F.to_json(F.struct(F.col(metric).alias("value"))) if metric else none)) for rule_id, hit, message, metric in rules if config.enabled(rule_id)])).cast(YIELD)]
    named = lambda rule_id, names, message: F.transform(names, lambda n: row(rule_id, start, name, F.concat(F.lit(message), n), F.to_json(F.struct(n.alias("name")))))
    nothing = F.array().cast("array<string>")
    if config.enabled("waste.unused-parameter"):
        unused = F.filter(parameter_names(F.col("par")), lambda n: ~n.startswith("_") & ~_names(inner, n) & ~_in_hole(body, n))
        parts.append(named("waste.unused-parameter", F.when(declared | signature, nothing).otherwise(unused), "A parameter is not used: "))
    if config.enabled("test-quality.unused-mock"):
        mocks = F.filter(F.regexp_extract_all(code, F.lit(java(MOCK_DECLARED)), F.lit(1)), lambda n: F.regexp_count(code, _word(n)) <= 1)
        parts.append(named("test-quality.unused-mock", F.when(test, mocks).otherwise(nothing), "A mock is not used: "))
    if config.enabled("naming.generic-parameter"):
        least = lambda option: config.option("naming.generic-parameter", option)
        large = (F.size(parameter_names(F.col("par"))) >= least("minParameters")) | (F.col("line_count") >= least("minLineCount")) | (F.col("cyclo") >= least("minCyclomatic"))
        generic = F.filter(parameter_names(F.col("par")), lambda n: F.lower(n).isin(sorted(config.placeholder_names)))
        parts.append(F.transform(F.when(large, generic).otherwise(nothing), lambda n: row("naming.generic-parameter", F.col("declaration_line"), n, F.lit("A parameter's name says nothing."), none)))
    if config.enabled("waste.redundant-variable"):
        places = F.when(has(RETURNED), _offsets(code, FRONT_AND_RETURNED)).otherwise(F.array().cast("array<struct<line:int,name:string>>"))
        parts.append(F.transform(places, lambda m: row("waste.redundant-variable", start + m["line"], m["name"], F.lit("A variable is only returned."), none)))
    if config.enabled("waste.useless-return"):
        lines = F.split(code, "\n")
        last = F.coalesce(F.array_max(F.transform(lines, lambda x, i: F.when(~_bare(x).isin("", "}"), i))), F.lit(-1))
        bare_return = F.coalesce(F.regexp_like(_bare(F.get(lines, last)), F.lit(java(r"^return\s*;?$"))), false)
        parts.append(F.when(bare_return, F.array(row("waste.useless-return", start + last, name, F.lit("The last line returns nothing."), none))).otherwise(F.array().cast(YIELD)))
    return F.concat(*parts)


def _magic(expression: Column, value: Column) -> Column:
    """Whether a number is neither small nor the status of a response."""
    whole = value == F.floor(value)
    status = whole & value.between(100, 599) & expression.rlike(java(r"\b(?:status|statusCode)\b"))
    return ~(whole & value.between(-1, 3)) & ~status


def _word(name: Column) -> Column:
    """A pattern for a name of which ``$`` is the only special character."""
    return F.concat(F.lit(r"(?<![A-Za-z0-9_])"), F.replace(name, F.lit("$"), F.lit(r"\$")), F.lit(r"(?![A-Za-z0-9_])"))


def _names(text: Column, name: Column) -> Column:
    return F.regexp_like(text, _word(name))


def _in_hole(text: Column, name: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(r"\$\{[^}]*"), _word(name), F.lit(r"[^}]*\}")))
