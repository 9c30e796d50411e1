"""Parsers: accepted and refused sources of each language, recovery, and the operator's edge cases."""

import datetime as dt

import pytest

from sievework.llm import syntax
from sievework.llm.data_parsers import json_errors, yaml_errors
from sievework.llm.script_parser import script_errors
from sievework.llm.syntax import accepted_by, errors_of

GOOD = {
    "ts": [
        "", "#!/usr/bin/env node\nlet a: Map<string, Array<number>> = new Map<string, Array<number>>();", "abstract class A<T extends object = {}> extends B<T> implements C, D { private readonly x?: number; static #p = 1; constructor(private a: string, public b = 2) { super(); } get v(): number { return 1 } set v(x) {} abstract m(): void; [k: string]: any; static { this.#p++; } declare y: string; @d() async *gen<T>(this: A<T>): AsyncGenerator<T> { yield* x; } }",
        "type F = (a: number, ...r: string[]) => asserts a is number; type M = { readonly [K in keyof T]?: T[K] extends infer U ? U : never }; type T1 = [a: string, b?: number, ...c: X[]]; type L = `a${string}b`; type C = new () => X; type I = import('x').Y<Z>;",
        "enum E { A = 1, 'b' = A << 2 } declare module 'x' { export const y: string; } namespace N.M { export type Q = 1 } declare global { interface Window { a: 1 } }",
        "const f = async <T,>(x: T): Promise<T> => x as unknown as T; const g = (a?: string): a is string => !!a; let z = a! < b; x = y satisfies Z; for (const [k, v] of Object.entries(o)) continue;",
        "export default function <T>(x: T) {} export type { A } from './a'; import type B, { type C as D } from 'b'; export = x; import y = require('y'); export as namespace Z;",
        "function over(a: string): void; function over(a: number): void; function over(a: any) { return a < 3 && b > (c); }", "let x = a ? (b) : c => d; let y = a ? (b, c) : d; let u: unique symbol; const q = <T>(v: T) => v; if (a < b || c > d) e();",
    ],
    "tsx": ["const a = <div className=\"x\" {...p} on={() => 1}>it's {a /* c */} {/* only */}<></><A.B<string> x='1' y=<b/> /></div>; const g = <T,>(x: T) => <b>{x}</b>;"],
    "js": ["a = b / c / d; r = /[/]\\/(?<n>x)/giu.test(x) ? `a${`b${1}`}c` : 0x1F + 1_000n; label: for (;;) { break label } var yield_, async, of, get; async = 1; ({ get: 1, async: 2, set, async *x() {}, get y() { return 1 }, [z]: 1, 'q'() {} });", "x = a ?? b; y = a?.b?.[c]?.(d); z ||= 1; w **= 2; if (a) ; else b(); do x(); while (y) z()\nthrow new Error('x')", "export { default as a, b as 'c' } from 'x'; import d, * as e from 'e' with { type: 'json' }; await top;", "const s = `<<<<<<< HEAD\n=======\n>>>>>>> x`;", "var let_ = function* () { const x = yield; yield* y }; new (foo())(); class A extends (B, C) { static async = 1; get; set; static() {} }", "return_ = 1\n++x\na\n(b)", "if (x) function f() {}", "for (var i in {}) ;"],
    "jsx": ["export const A = () => <p>Don't panic &amp; {x}</p>;"],
    "mjs": ["import fs from 'fs'; export const x = await fs.y; import.meta.url; import('x');"],
    "cjs": ["const a = require('a'); if (a) return; module.exports = { await: 1 }; with (a) b();"],
}
BAD = {
    "ts": ["function f() {", "let x = 'open", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "const a = <div/>;", "/* open", "class A { m( { }", "let 1a;", "return 1;", "a = b c;", "x = `open ${a", "function f() { await x; }", "const x;", "if (a { }", "“x”", "a => { }}", "type X = ;", "interface A { b: }", "enum { A }", "foo(a b)"],
    "js": ["let x: number = 1;", "interface A { x: string }", "a = /open", "class { }", "break;", "a ?? b || c", "x = {a b}", "var 1", "import x from", "for (;;", "1 = 2", "name: entry\nsteps:\n  - run: x", "function f(a,,b) {}", "def f(x):\n    return 1"],
    "mjs": ["return 1", "with (a) b()"], "cjs": ["import a from 'a';", "export const x = 1;", "await x;"], "jsx": ["<a><b></a>", "<p>{</p>", "x = <a"], "tsx": ["const a = <T>x;"],
}


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in GOOD.items() for t in ts])
def test_accepts(ext, text):
    assert script_errors(text, ext) == []


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in BAD.items() for t in ts])
def test_refuses(ext, text):
    assert script_errors(text, ext)


def test_recovery_reports_several_errors_and_the_first_place():
    text = "const a = ;\nfunction ok() { return 1; }\nlet b = = 2;\nconst c = 3;\n"
    errors = script_errors(text, "ts")
    assert len(errors) == 2 and text.count("\n", 0, errors[0][0]) == 0 and text.count("\n", 0, errors[1][0]) == 2


def test_deep_nesting_and_long_files():
    assert script_errors("(" * 3000 + "1" + ")" * 3000, "js") == []
    assert script_errors("x(1);\n" * 50_000, "ts") == []


def test_json():
    assert not json_errors('﻿{"a": [1, 2.5e3, "x", null, true]}')
    for bad in ("", "{", "{'a': 1}", '{"a": 1,}', '{"a": NaN}', '{"a": 1} x', '{"a": "\n"}'):
        assert json_errors(bad), bad
    assert not json_errors('{ // c\n "a": "// no", /* d */ "b": [1,], }', relaxed=True) and json_errors('{"a": 1 "b"}', relaxed=True)


@pytest.mark.parametrize("text", ["", "# only\n", "a: 1\nb:\n  - x\n  - y: 2\n    z: 3\n", "a:\n- x\n- y\nb: {c: [1, 2], d: 'it''s'}\n", "k: |\n  any: thing [\n\n  more\nl: >-\n  x\n", "---\na: &x 1\nb: *x\n...\n---\nc: \"two\n  lines\"\n", "a: 'b: c'", "- - 1\n  - 2\n- a: 1\n  b: 2\n", "url: http://a.b:80/c#d\nt: ${{ secrets.X }}\nn: ~\n", "plain text\n  over lines\n", "\"q k\": v\n", "a: [x,\n  y]\n", "\r\na: 1\r\nb: 2\r\n"])
def test_yaml_accepts(text):
    assert yaml_errors(text) == []


@pytest.mark.parametrize("text", ["a: [1, 2\nb: 3\n", "a:\n\tb: 1\n", "a: 1\n  b: 2\n", "a: 'open\n", "<<<<<<< HEAD\na: 1\n=======\n", "a: 1\nnot a key\n", "a: b: c\n", "a:\n   b: 1\n  c: 2\n", "a: {b: 1\n", "a: @x\n", "a: 1\n- b\n", "a: \"x\" y\n", "a: ]\n"])
def test_yaml_refuses(text):
    assert yaml_errors(text)


def lines(text, errors):
    return [text.count("\n", 0, at) + 1 for at, _ in errors]


@pytest.mark.parametrize("text,want", [
    ('{\n  "a": 1,\n<<<<<<< HEAD\n  "b": 2,\n=======\n  "b": 3,\n>>>>>>> x\n  "c": [1, 2]\n}\n', [3, 5, 7]),
    ("{\n  a: 1,\n  'b': 'c d',\n  \"e\": 2\n}", [2, 3, 3]),
    ('[1, NaN,\n undefined,\n {"a" 1},\n {"b": 2 "c": 3},\n "x\\q",\n 4,\n]', [1, 2, 3, 4, 5, 6]),
    ('{\n "a": "open,\n "b": 1,\n "c": ,\n "d": [1, 2}\n', [2, 4, 5]),
    ('{"a": 1}}\n{"b": x}', [1, 2]), ("[" * 5000 + "x", [1, 1]),
])
def test_json_recovers(text, want):
    assert lines(text, json_errors(text)) == want


@pytest.mark.parametrize("text,want", [
    ("a: b: c\nok: 1\nd: @x\ne:\n  f: 'g' h\n  i: 2\nj: ]\n", [1, 3, 5, 7]),
    ("a: 1\n<<<<<<< HEAD\nb: 2\n=======\nb: 3\n>>>>>>> x\nc: 4\n", [2, 4, 6]),
    ("- a: b: c\n- x\n- - 1\n  - y: @z\n- [1, @, 2, `, 3]\n- {a: @x,\n   b: %y}\n", [1, 4, 5, 5, 6, 7]),
    ("a:\n\tb: 1\n\tc: 2\nd: 'x' y\n---\ne: @\n", [2, 4, 6]),
    ("a: [1, 2]\nb: [1\nc: d: e\n", [3]),
])
def test_yaml_recovers(text, want):
    assert lines(text, yaml_errors(text)) == want


def test_scripts_recover_from_a_wrong_first_token():
    text = "'x;\nlet ok = 1;\nlet b = = 2;\n"
    assert lines(text, script_errors(text, "ts")) == [1, 3]


def test_errors_are_returned_per_file(spark):
    rows = [(1, "r", "a.yml", "a: b: c\nd: @x\n", 0), (2, "r", "b.json", '{\na: 1,\n"b": x}', 0), (3, "r", "c.ts", "let x = ;\nlet y = 1;\nlet z = = 2;", 0), (4, "r", "d.json", "{}", 0)]
    got = {r["file_id"]: r for r in syntax.parsed_files(files(spark, rows)).collect()}
    assert {k: [e["line"] for e in r["errors"]] for k, r in got.items()} == {1: [1, 2], 2: [2, 3], 3: [1, 3], 4: []}
    assert all(r["n_errors"] == len(r["errors"]) and (not r["errors"] or (r["first_line"], r["first_cause"]) == tuple(r["errors"][0])) for r in got.values())


def files(spark, rows):
    at = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, r, p, t, at + dt.timedelta(days=d), "clash", 1) for i, r, p, t, d in rows], "file_id long, repo string, display_path string, text string, ingested_at timestamp, language string, n_errors int")


def test_operator_edges(spark):
    rows = [(1, "r", "a.ts", "let x = ;", 0), (1, "r", "a.ts", "let x = 1;", 1), (2, None, "b.json", "", 0), (3, "r", None, "x", 0), (4, "r", "c.ts", None, 0), (5, "r", "d.txt", "((", 0), (6, "r", "tsconfig.json", "{ /* c */ }", 0), (7, "r", "e.ts", "a b", 0), (7, "r", "e.ts", None, 2), (None, "r", "f.ts", "(", 0)]
    got = {r["file_id"]: r["n_errors"] for r in syntax.parsed_files(files(spark, rows)).collect()}
    assert got == {1: 0, 2: 1, 6: 0}
    assert syntax.parsed_files(files(spark, [])).count() == 0


def test_no_depth_is_an_error_and_other_languages_are_told():
    for n in (3_000, 30_000):
        assert errors_of("x = " + "[" * n + "]" * n, "a.ts") == [] and errors_of("[" * n + "]" * n, "a.json") == [] and errors_of("x = " + "(" * (n // 10) + "1" + ")" * (n // 10), "a.js") == []
        assert errors_of("[" * n + "]" * (n - 1), "a.json") != [] and errors_of("{" * n + "}" * n, "a.js") == []
    assert errors_of("a: " + "[" * 5_000 + "]" * 5_000, "a.yml") == []
    assert accepted_by('{"a": 1}') == ["json", "yaml"] and "ts" in accepted_by("const a: string = b;") and "cjs" not in accepted_by("const a: string = b;")
    assert accepted_by("a: [b, {c\n") == []
