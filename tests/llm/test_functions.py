"""Functions and their documentation."""

import datetime as dt
import sys

import pytest

from sievework.llm import functions
from sievework.llm.functions import Islands, _pairs, documented, is_code, useful_words

TEXT = """// Says what this file is for and nothing else.
import x from 'x';

/** Adds the two numbers after rounding both. */
export function add(a: number, b: number): { sum: number } {
  // Inner helper rounds toward the even neighbour.
  const round = (v) => {
    return v;
  };
  return { sum: round(a) };
}

// add two
function addTwo(two) { return two + 2; }

/**
 * TODO: describe
 * @param first
 * @returns {void}
 */
const noted = async (first) => { };

class Box<T> {
  field = () => { return 1; };
  /** Keeps only what arrived since yesterday. */
  @memo()
  // eslint-disable-next-line no-console
  private async keep(items: T[]): Promise<T[]> {
    return items;
  }
  open(): void;
}

// Drops what is older than a day.
test("drops", () => { });

// const gone = 1;
// gone.call(this);
const expression = (a) => a + 1;
// Explains the object and its method.
const o = { method() { return "it's"; } };
foo(function named() {}); // trailing words that belong to the call
function after() {}
"""


def lines(text, **kw):
    return {(i.name, text.count("\n", 0, i.name_at) + 1) for i in documented(text, **kw)}


def test_finds_documented_functions_only():
    assert {n for n, _ in lines(TEXT)} == {"add", "round", "keep"}
    assert ("keep", 28) in lines(TEXT)
    assert {i.name for i in Islands(TEXT).all()} == {"add", "round", "addTwo", "noted", "keep", "after"}


def test_usefulness():
    assert useful_words("/** Validate finding. */", "validateFinding", ()) == []
    assert len(useful_words("/** @param a - rows that stay */", "f", ("a",))) == 3
    assert useful_words("// eslint-disable-next-line no-console, no-continue\n// ==== load ====\n// TODO write this", "f", ()) == []
    assert useful_words("// {@link Other} @internal", "f", ()) == []
    assert is_code("if (a.b) { c(); }") and is_code("} else {") and is_code("return a(b) * c;") and not is_code("Caller owns the array; nothing here retains it.") and not is_code("see foo() for more")


def test_invalid_empty_and_foreign_files_give_nothing():
    assert _pairs(TEXT + "}", "a.ts")["pairs"] == [] and _pairs(None, "a.ts")["pairs"] == [] and _pairs("", "a.ts")["pairs"] == [] and _pairs(TEXT, "a.md")["pairs"] == [] and _pairs(TEXT, None)["pairs"] == []
    pair = {p["name"]: p for p in _pairs(TEXT, "a.ts")["pairs"]}["add"]
    assert pair["declaration_line"] == 5 and pair["code"].startswith("export function add") and pair["code"].endswith("}") and pair["doc"] == "Adds the two numbers after rounding both."


def test_markup_text_and_templates_do_not_confuse():
    text = "// Renders one row of the table.\nfunction Row() {\n  return <p>Don't {`}${'}'}`} panic</p>;\n}\n// Counts what is left over.\nfunction rest() { return /[}'\"]/.test(x); }\n"
    assert {n for n, _ in lines(text)} == {"Row", "rest"}


def test_class_heads_with_several_interfaces():
    head = "/** Keeps only what arrived since yesterday. */\n  go(a) { return a; }\n}\n"
    for text in ("class A implements B, C {\n  ", "class A<T> extends B<T> implements C<T, U>, n.D, E {\n  ", "export default class extends mixin(A, B) implements C, D {\n  "):
        assert lines(text + head) == {("go", 3)}, text


def files(spark, rows):
    at = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, "r", p, t, at + dt.timedelta(days=d)) for i, p, t, d in rows], "file_id long, repo string, display_path string, text string, ingested_at timestamp")


def test_a_file_that_fails_is_no_file_without_functions(spark, monkeypatch, tmp_path):
    work = _pairs

    def failing(text, path):
        if "FAIL" in text:
            raise ValueError("no")
        return work(text, path)

    monkeypatch.setattr(functions, "_pairs", failing)
    plain = "function bare() {}\n"
    # 1 has functions, 2 has none, 3 fails, 4 failed in a delivery that another replaced, 5 fails only in the last one
    rows = [(1, "a.ts", TEXT, 0), (2, "b.ts", plain, 0), (3, "c.ts", "FAIL", 0), (4, "d.ts", "FAIL", 0), (4, "d.ts", plain, 1), (5, "e.ts", TEXT, 0), (5, "e.ts", "FAIL", 1)]
    got = functions.documented_functions(files(spark, rows)).collect()
    assert {(r.file_id, r.name, r.error) for r in got} == {(1, "add", None), (1, "round", None), (1, "keep", None), (3, None, "ValueError: no"), (5, None, "ValueError: no")}
    assert all((r.declaration_line is None) == (r.code is None) == (r.error is not None) for r in got)
    for name, some in (("failed", rows), ("sound", [r for r in rows if r[0] not in (3, 5)])):
        files(spark, some).write.parquet(f"{tmp_path}/{name}/files.parquet")
    assert functions.p1_found(spark, f"{tmp_path}/sound").count() == 3
    for end in ("collect", "count"):
        with pytest.raises(Exception, match=r"file [35] \([ce]\.ts\) could not be searched: ValueError: no"):
            getattr(functions.p1_found(spark, f"{tmp_path}/failed"), end)()


@pytest.mark.parametrize("deep", ["(" * 2_000 + "1" + ")" * 2_000, "[" * 2_000 + "1" + "]" * 2_000, "{" * 2_000 + "a" + "}" * 2_000, "!" * 9_000 + "a", "x = " + "a=>" * 2_000 + "1", "f(" * 2_000])
def test_no_depth_of_a_comment_fails(deep):
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(1_000)  # that of a new worker, which has seen no large file
    try:
        assert lines(f"// {deep};\nfunction bare() {{}}\n" + TEXT) >= {("add", 7), ("keep", 30)}
    finally:
        sys.setrecursionlimit(limit)
