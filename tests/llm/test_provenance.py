"""Generated, minified, vendored and data files."""

import datetime as dt

from sievework.llm import provenance as P

HAND = "import { a } from './a';\n\n// Adds what is new.\nexport function add(x) {\n  if (x.old) {\n    return a(x);\n  }\n  for (const y of x.all) {\n    a(y, 'text');\n    if (y.late && !y.gone) {\n      a(y.first, y.second, x.third);\n    }\n  }\n  return null;\n}\n"


def test_marks():
    assert P.own_marks(HAND, "src/a.ts") is None
    assert P.own_marks("// @generated by x\n" + HAND, "src/a.ts") == "generated" and P.own_marks("/*\n * Code generated by x; DO NOT EDIT.\n */\n" + HAND, "a.ts") == "generated"
    assert P.own_marks('// Template for the header that says DO NOT EDIT.\nconst H = "// @generated - DO NOT EDIT";\n' + HAND, "src/a.ts") is None
    assert P.own_marks("// Reads the output of the code generator. Generated files are not touched.\n" + HAND, "src/a.ts") is None
    assert P.own_marks("export const T = [\n" + "  12, 4711, 99, 7, 0x1f, 22,\n" * 40 + "];\n", "src/t.ts") == "data"
    assert P.own_marks("var a=1;" * 80 + "function b(c){return c.d?c[1]:b(c,2)};", "x.js") == "minified"
    assert P.own_marks("/*! lib v1.2.3 | (c) the authors */\n" + HAND, "src/utils/x.js") == "vendored" and P.own_marks(HAND, "third_party/x.js") == "vendored" and P.own_marks(HAND, "src/vendors/x.js") is None
    assert P.own_marks('{"lockfileVersion": 2}', "package-lock.json") == "lock" and P.own_marks('{"a": 1}', "config/a.json") is None
    assert P.own_marks("", "a.ts") is None and P.own_marks(HAND + "const L = '" + "x" * 900 + "';\n", "src/a.ts") is None


def frame(spark, rows):
    return spark.createDataFrame([(i, r, p, t, dt.datetime(2025, 1, 1), "x") for i, r, p, t in rows], "file_id long, repo string, display_path string, text string, ingested_at timestamp, hash string")


def test_copies_in_unrelated_repositories(spark):
    lib = HAND.replace("add", "libAdd")
    own = [HAND.replace("add", f"own{i}").replace("text", "q" * i) for i in range(12)]
    rows = [(1, "a", "src/u/one.js", lib), (2, "b", "lib/other.js", "// new banner\n" + lib.replace("\n", "\r\n")), (3, "a", "src/own.ts", own[0]), (4, "b", "src/b.ts", own[1])]
    rows += [(5, "a", "src/u/copy.js", lib), (6, None, "src/x.ts", own[2]), (7, "a", None, lib), (8, "a", "src/null.ts", None), (9, "a", "src/empty.ts", "")]
    # a fork shares nearly all with its origin: no third-party code
    rows += [(20 + i, r, f"src/f{i}.ts", own[3 + i]) for r in ("fork", "origin") for i in range(6)]
    rows = [(i if r != "fork" else i + 100, r, p, t) for i, r, p, t in rows]
    # small files in a shared folder come with it
    rows += [(300 + k, r, p, t) for k, (r, p, t) in enumerate((r, f"{r}/kit/{n}", t) for r in ("c", "d") for n, t in (("big.js", own[10]), ("tiny.js", "x();")))]
    rows += [(400 + k, r, f"{r}/own{k}.ts", own[11].replace("own11", f"{r}{k}").replace("q", r * (k + 5))) for k, r in enumerate("cdcdcd")]
    got = {r["file_id"] for r in P.not_handwritten(frame(spark, rows)).collect()}
    assert got == {1, 2, 5, 300, 301, 302, 303}
    assert P.not_handwritten(frame(spark, [])).count() == 0


def test_marks_that_stand_late():
    from sievework.llm.provenance import own_marks

    code = "export function keep(a) {\n  return a + 1;\n}\n"
    for before in (14, 80):
        assert own_marks("/*\n" + " * words of the purpose\n" * before + " * Copyright 2019 The Upstream Authors\n */\n" + code, "src/a.js") == "vendored"
        assert own_marks("/*\n" + " * words of the purpose\n" * before + " */\n" + code, "src/a.js") is None
    assert own_marks("packages:\n" + "  - name: x\n" * 400 + "lockfileVersion: 6\n", "deps/state.yaml") == "lock"
