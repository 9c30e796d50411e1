"""Every rule on a source that it has to find and on one that it must not; fingerprints that have to stay as they are."""

import os

import duckdb
import pytest

from sievework.operators import analyse as A
from sievework.operators.catalog import RULES
from sievework.plans import analysis

AWS, JWT, CARD = "AKIA" + "ABCDEFGHIJKLMNOP", "eyJhbGciOiJI" + ".eyJzdWIiOiIx.c2lnbmF0dXJl", "4111 1111" + " 1111 1111"
DENSE = "Zx7pQ9vLm3N8sT2rY6" + "wK1dF4gH5jC0bR2"
TALL = "\n".join(f"  step{i}();" for i in range(210))
BRANCHES = "\n".join(f"  if (a === {i}) go();" for i in range(16))
SOURCE_LINES = "\n".join(f"const line{i} = {i};" for i in range(14))
SETUP = "\n".join(f"  const item{i}x = make();" for i in range(13))
WORKFLOW = ".github/workflows/a.yml"


def in_test(body, name="works"):
    return f"test('{name}', () => {{\n{body}\n}});\n"


# rule: (what is found, what is not); a text stands for the one file a.ts.
CASES = {
    "complexity.cognitive": (f"function f(a) {{\n{BRANCHES}\n}}", "function f(a) {\n  if (a) { go(); }\n}"),
    "complexity.cyclomatic": (f"function f(a) {{\n{BRANCHES}\n}}", "function f(a) {\n  if (a) { go(); }\n}"),
    "dead-code.unused-private-method": ("class A {\n  private gone() {}\n}", "class A {\n  private used() {}\n  go() { this.used(); }\n}"),
    "design.circular-import": ({"a.ts": "import './b';", "b.ts": "import './a';"}, {"a.ts": "import './b';", "b.ts": "import type { A } from './a';"}),
    "design.deep-relative-import": ("import '../../../x';", "import '../../x';"),
    "design.large-module-concentration": ({"big.ts": "x();\n" * 100, "b.ts": "", "c.ts": "", "d.ts": ""}, {f"{i}.ts": "x();\n" * 100 for i in range(4)}),
    "design.package-bin-missing": ({"package.json": '{"bin": {"x": "./gone.js"}}'}, {"package.json": '{"bin": {"x": "./x.js"}}', "x.js": ""}),
    "design.package-bin-not-executable": ({"package.json": '{"bin": {"x": "./x.js"}}', "x.js": ""}, {"package.json": '{"bin": {"x": "./run.js"}}', "run.js": ""}),
    "docs.fixture-purpose-missing": ({"a.test.ts": f"const sourceFixture = `{SOURCE_LINES}`;"}, {"a.test.ts": f"// Reproduces a long source.\nconst sourceFixture = `{SOURCE_LINES}`;"}),
    "docs.magic-threshold-without-rationale": ("const retryLimit = 12;", "// The limit is tuned by hand.\nconst retryLimit = 12;"),
    "docs.missing-error-behavior-doc": ("// Parses what came in.\nfunction parseIt(x) { throw new Error(x); }", "// Parses what came in, throws otherwise.\nfunction parseIt(x) { throw new Error(x); }"),
    "docs.missing-exported-function-doc": ("export function f() { go(); }", "// Goes on.\nexport function f() { go(); }"),
    "docs.missing-file-overview": ("import 'x';", "// What this is for.\nimport 'x';"),
    "docs.missing-interface-doc": ("interface Shape {\n  a: string;\n}", "/** What a shape holds. */\ninterface Shape {\n  a: string;\n}"),
    "docs.missing-internal-function-doc": ("function f() { go(); }", "// Goes on.\nfunction f() { go(); }"),
    "docs.missing-invariant-doc": ("/** Details of the envelope. */\ninterface Envelope {\n  fingerprint: string;\n}", "/** Envelope whose schema must hold. */\ninterface Envelope {\n  fingerprint: string;\n}"),
    "docs.missing-param-tag": ("/**\n * Adds numbers.\n */\nexport function add(amount: number) { return amount; }", "/**\n * Adds numbers.\n * @param amount What to add.\n */\nexport function add(amount: number) { return amount; }"),
    "docs.missing-public-doc": ("export class Shape {}", "/** What a shape is. */\nexport class Shape {}"),
    "docs.missing-return-tag": ("/** Adds numbers well. */\nexport function add(): number { return 1; }", "/** Adds numbers well.\n * @returns the sum */\nexport function add(): number { return 1; }"),
    "docs.missing-side-effect-doc": ("// Saves the output here.\nfunction save(p) { writeFileSync(p, ''); }", "// Writes the output here.\nfunction save(p) { writeFileSync(p, ''); }"),
    "docs.missing-why-for-complex-code": (f"// Handles all the states.\nfunction f(a) {{\n{BRANCHES}\n}}", f"// Handles all the states because tables fail.\nfunction f(a) {{\n{BRANCHES}\n}}"),
    "docs.stale-comment": ("// See `src/gone.ts` for more.\ngo();", "// Legacy: `src/gone.ts` is no more.\ngo();"),
    "docs.stale-param-tag": ("/**\n * Adds numbers.\n * @param gone What left.\n */\nexport function add() { go(); }", "/**\n * Adds numbers.\n */\nexport function add() { go(); }"),
    "docs.suppression-without-rationale": ("// eslint-disable-next-line no-x\ngo();", "// eslint-disable-next-line no-x -- because of y\ngo();"),
    "docs.todo-without-tracking": ("// TODO: later\ngo();", "// TODO: later, see #12\ngo();"),
    "docs.useless-docblock": ("/** updateName */\nfunction updateName() { go(); }", "/** Renames what is stored everywhere. */\nfunction updateName() { go(); }"),
    "waste.any-type": ("let a: any;", "let a: string; // : any"),
    "waste.broad-runtime-version": ({"package.json": '{"dependencies": {"a": ">=1"}}'}, {"package.json": '{"dependencies": {"a": ">=1 <2"}, "devDependencies": {"b": "*"}}'}),
    "waste.commented-out-code": ("// const a = load();", "// Const values are loaded (see below)\n// e.g.: const a = 1"),
    "waste.console-log": ("console.log(1);", {"scripts/a.ts": "console.log(1);", "b.ts": "const s = 'console.log(1)';"}),
    "waste.empty-function": ("function f() {}", {"a.ts": "function f() { go(); }\ninterface I {\n  m(a: string): void;\n}", "b.test.ts": "function f() { /* stub */ }"}),
    "waste.exported-any": ("export function f(a: any) { go(a); }", "export function f(a: string) { go(a); }"),
    "waste.redundant-boolean-cast": ("if (!!ready) { go(); }", "if (ready) { go(); }"),
    "waste.redundant-variable": ("function f() {\n  const x = go();\n  return x;\n}", "function f() {\n  const x = go();\n  return x + 1;\n}"),
    "waste.swallowed-catch": ("try { go(); } catch (e) {\n  // FIXME\n}", "try { go(); } catch (e) {\n  // already closed\n}"),
    "waste.unreachable-code": ("function f() {\n  return 1;\n  go();\n}", "function f() {\n  if (\n    a\n  )\n    return 1;\n  go();\n}"),
    "waste.unused-import": ("import { a, b as c } from 'x';\na();", "import { a, b as c } from 'x';\na(`${c}`);"),
    "waste.unused-parameter": ("function f(used, spare) { go(used); }", "function f(used, _spare) { go(`${used}`); }"),
    "waste.useless-catch": ("try { go(); } catch (e) { throw e; }", "try { go(); } catch (e) { throw new Wrapped(e); }"),
    "waste.useless-return": ("function f() {\n  go();\n  return;\n}", "function f() {\n  if (x) { return; }\n  go();\n}"),
    "modernisation.date-now-candidate": ("const t = new Date().getTime();", "const t = new Date(x).getTime();"),
    "modernisation.double-cast": ("const u = a as unknown as { b: string };", "const u = a as unknown;"),
    "modernisation.loose-equality": ("if (a == b) { go(); }", "if (a === b || a == null || null != b) { go(); }"),
    "modernisation.non-null-assertion": ("go(a.b!.c);", "go(a != b, !c);"),
    "modernisation.nullish-coalescing-candidate": ("const a = b || 'x' || 0;\nconst d = e || 0;", "const a = b || c;"),
    "modernisation.object-spread-candidate": ("const a = Object.assign({}, b);", "const a = Object.assign(c, b);"),
    "modernisation.optional-chaining-candidate": ("go(a && a.b);", "go(a && b.a);"),
    "modernisation.public-property": ("class A {\n  public a = 1;\n}", "class A {\n  public a() {}\n}"),
    "modernisation.readonly-property-candidate": ("class A {\n  private a: string;\n}", "class A {\n  private readonly a: string;\n}"),
    "modernisation.ts-comment-without-rationale": ("// @ts-" + "ignore\ngo();", "// @ts-" + "expect-error the types are wrong upstream\ngo();"),
    "modernisation.tsconfig-exact-optional-disabled": ({"tsconfig.json": '{"compilerOptions": {}}'}, {"tsconfig.json": '{"compilerOptions": {"exactOptionalPropertyTypes": true}}'}),
    "modernisation.tsconfig-index-safety-disabled": ({"tsconfig.json": '{"compilerOptions": {"noUncheckedIndexedAccess": false}, "extends": "x"}'}, {"tsconfig.json": '{"extends": "x"}'}),
    "modernisation.tsconfig-strict-disabled": ({"tsconfig.a.json": "{ // none\n}"}, {"tsconfig.json": '{"compilerOptions": {"strict": true,},}'}),
    "modernisation.var-declaration": ("var a = 1;", "let a = 'var b';"),
    "naming.acronym-case": ("const userURL = 1;\nconst pageUrl = 2;", "const userUrl = 1;\nconst pageUrl = 2;"),
    "naming.boolean-prefix": ("const ready = true;", "const isReady = true;\nconst selected = false;"),
    "naming.class-file-mismatch": ({"other.ts": "export class Shape {}"}, {"sh_ape.ts": "export class Shape {}"}),
    "naming.generic-function": ("function process() { go(); }", "function processOrder() { go(); }"),
    "naming.generic-parameter": ("function f(data, b, c) { go(data, b, c); }", "function f(data) { go(data); }"),
    "naming.hungarian-notation": ("const strName = 1;", "const strong = 1;"),
    "naming.identifier-quality": ("const data1 = 1;", "const order1 = 1;"),
    "naming.inconsistent-casing": ("const userId = 1;\nconst userID = 2;", "const userId = 1;\nconst USER_ID = 2;"),
    "naming.negative-boolean": ("const disableCache = true;", "const notice = true;"),
    "naming.short-variable": ("const qq = 1;", "for (const f of files) {\n  go(f);\n}\nconst id = 1;"),
    "security.async-foreach": ("a.forEach(async (x) => go(x));", "a.map(async (x) => go(x));"),
    "security.disabled-tls-verification": ("const o = { rejectUnauthorized: false };", "const o = { rejectUnauthorized: true }; // rejectUnauthorized: false"),
    "security.document-write": ("document.write(x);", "documents.write(x);"),
    "security.dynamic-regexp": ("function f(req) {\n  const p = req.query.p;\n  return new RegExp(\n    p,\n  );\n}", "function f(req) {\n  const p = req.query.p;\n  return new RegExp(escapeRegExp(p));\n}"),
    "security.eval-call": ("eval(x);", "evaluate(x); // eval(x)"),
    "security.floating-promise": ("  saveAsync(x);", "  await saveAsync(x);\n  const p = saveAsync(x);\n  api.fetch(x);"),
    "security.github-actions-broad-permissions": ({WORKFLOW: "permissions:\n  contents: write\n"}, {WORKFLOW: "permissions:\n  contents: read\njobs:\n  contents: write\n"}),
    "security.github-actions-pull-request-target": ({WORKFLOW: "on: pull_request_target\njobs:\n  a:\n    steps:\n      - run: x\n"}, {WORKFLOW: "on: pull_request\njobs:\n  a:\n    steps:\n      - run: x\n"}),
    "security.github-actions-remote-shell": ({WORKFLOW: "      - run: |\n          curl -f https://x.example/a |\n          bash\n"}, {WORKFLOW: "      - run: curl -f https://x.example/a\n"}),
    "security.github-actions-secrets-in-pr": ({WORKFLOW: "on: [pull_request]\n  - run: |\n      echo ${{ secrets.KEY }}\n"}, {WORKFLOW: "on: push\n  - run: echo ${{ secrets.KEY }}\n"}),
    "security.github-actions-unpinned-action": ({WORKFLOW: "  - uses: other/thing@v1\n"}, {WORKFLOW: f"  - uses: other/thing@{'a1' * 20}\n  - uses: actions/checkout@v4\n  - uses: ./own@v1\n"}),
    "security.inner-html": ("a.innerHTML = b;", "a.innerHTML = '';"),
    "security.insecure-random": ("Math.random();", "myMath.randomize();"),
    "security.javascript-url": ("const u = 'javascript:go()';", "const u = 'a javascript: URL';\n// 'javascript:go()'"),
    "security.new-function": ("new Function(x);", "new FunctionTable(x);"),
    "security.open-redirect-candidate": ("function f(req, res) {\n  const next = req.query.next;\n  res.redirect(next);\n}", "function f(req, res) {\n  let next = req.query.next;\n  next = '/home';\n  res.redirect(next);\n}"),
    "security.path-traversal-candidate": ("readFileSync(req.query.file);", "function f(req) {\n  const name = req.query.name;\n}\nfunction g(name) {\n  readFileSync(name);\n}"),
    "security.process-exec": ("exec(command);", "pattern.exec(x);\nspawn('ls', []);"),
    "security.proto-access": ("const p = a['__proto__'];", "const p = '__proto__';"),
    "security.remote-install-script": ({"package.json": '{"scripts": {"x": "curl https://x.example | sh"}}'}, {"package.json": '{"scripts": {"x": "curl https://x.example"}}'}),
    "security.risky-lifecycle-script": ({"package.json": '{"scripts": {"postinstall": "x"}}'}, {"package.json": '{"scripts": {"build": "x"}}'}),
    "security.sql-concatenation": ('db.query("SELECT a FROM b WHERE c = " + id);', 'db.query("SELECT a FROM b WHERE c = ?", [id]);'),
    "security.ssrf-candidate": ("function f(ctx) {\n  const { url } = ctx.body;\n  return fetch(\n    url\n  );\n}", "function f(ctx) {\n  const url = 'https://x.example';\n  return fetch(url);\n}"),
    "security.string-timer": ("setTimeout('go()', 1);", "setTimeout(go, 1);\nclock.setTimeout('x', 1);"),
    "security.throw-non-error": ("throw 'bad';", "throw new Error('bad');\nthrow error;"),
    "security.unsafe-deserialization": ("function f(req) {\n  const body = req.body.raw;\n  s.unserialize(body);\n}", "function f(req) {\n  yaml.load(req.body.raw, { schema: JSON_SCHEMA });\n}"),
    "security.url-dependency": ({"package.json": '{"devDependencies": {"a": "git+ssh://x/y"}}'}, {"package.json": '{"dependencies": {"a": "^1.0.0"}}'}),
    "security.weak-crypto": ("const s = \"createHash('md5')\"; createHash('md5');", "const s = \"createHash('md5')\"; createHash('sha256');"),
    "security.xxe-candidate": ("const x = req.body.xml;\nlibxmljs.parseXml(x, { noent: true });", "const x = req.body.xml;\nlibxmljs.parseXml(x, { noent: false });"),
    "sensitive-data.api-key-pattern": ({".npmrc": "//r/:_authToken=" + "a1B2" * 6}, {".npmrc": "//r/:_authToken=${TOKEN}"}),
    "sensitive-data.aws-access-key": (f"const k = '{AWS}';", f"const k = '{AWS[:-1]}';"),
    "sensitive-data.database-url-password": ({".env": "URL=postgres://a:b@c/d"}, {".env": "URL=postgres://c/d"}),
    "sensitive-data.gcp-service-account-key": ({"k.json": '{"type": "service_account", "private_key": "x"}'}, {"k.json": '{"type": "service_account"}'}),
    "sensitive-data.hardcoded-env-value": ({".env": "API_TOKEN=" + "a1b2" * 5}, {".env": "API_TOKEN=${FROM_OUTSIDE}\nTOKEN=short1"}),
    "sensitive-data.high-entropy-string": (f"const k = '{DENSE}';", f"const k = '{'0af1' * 10}';\nconst p = 'src/{DENSE}.ts';"),
    "sensitive-data.jwt-token": (f"const k = '{JWT}';", "const k = 'eyJhbGci';"),
    "sensitive-data.phi-pattern": ({"a.json": '{"x": "MRN: 00489912"}'}, {"a.json": '{"x": "order 00489912"}'}),
    "sensitive-data.pii-pattern": (f"const c = '{CARD}';", f"const c = '{CARD[:-1]}2';"),
    "sensitive-data.private-key": ({"a.yml": "key: BEGIN RSA PRIVATE KEY"}, {"a.yml": "key: BEGIN PUBLIC KEY"}),
    "size.file-length": ("x();\n" * 751, {"package-lock.json": "\n" * 800, "a.ts": "x();\n" * 700}),
    "size.function-length": (f"function f() {{\n{TALL}\n}}", "function f() { go(); }"),
    "size.parameter-count": ("function f(a1, b1, c1, d1, e1, f1, g1, h1) {}", "function f(a1, b1, c1, d1, e1, f1, g1) {}"),
    "test-quality.conditional-logic": (in_test("  if (a) {\n    expect(a).toBe(b);\n  }"), in_test("  if (a) {\n    go();\n  }\n  expect(a).toBe(b);")),
    "test-quality.exception-type-only": (in_test("  expect(f).toThrow(TypeError);"), in_test("  expect(f).toThrow(/why/);")),
    "test-quality.global-state-mutation": (in_test("  process.env.A = 'x';"), in_test("  expect(process.env.A).toBe(b);")),
    "test-quality.loop-in-test": (in_test("  for (const x of xs) {\n    expect(x).toBe(b);\n  }"), in_test("  for (const x of [1, 2]) {\n    expect(x).toBe(b);\n  }")),
    "test-quality.magic-number-assertion": (in_test("  expect(total).toBe(42);"), in_test("  expect(response.status).toBe(404);\n  expect(n).toBe(2);")),
    "test-quality.missing-nearby-test": ({"src/a.ts": "x();\nexport const a = 1;"}, {"src/a.ts": "export const a = 1;", "src/__tests__/a.test.ts": "x();", "src/generated/b.ts": "export const b = 1;"}),
    "test-quality.mock-only-test": (in_test("  const fnMock = vi.fn();\n  expect(fnMock).toHaveBeenCalled();"), in_test("  const fnMock = vi.fn();\n  expect(fnMock).toHaveBeenCalled();\n  expect(result).toBe(b);")),
    "test-quality.no-assertions": (in_test("  go();"), in_test("  await assertValid(x);")),
    "test-quality.no-throw-only-test": (in_test("  expect(() => go()).not.toThrow();"), in_test("  expect(() => go()).not.toThrow();\n  assert.equal(a, b);")),
    "test-quality.only-skip": (in_test("  describe.only('x');"), in_test("  only('x');")),
    "test-quality.setup-bloat": (in_test(f"{SETUP}\n  expect(a).toBe(b);"), in_test("  const a = make();\n  expect(a).toBe(b);")),
    "test-quality.sleep-in-test": (in_test("  await sleep(5);"), in_test("  await sleeping(5);")),
    "test-quality.snapshot-only-test": (in_test("  expect(route(a, b(c))).toMatchSnapshot();"), in_test("  expect(a).toMatchSnapshot();\n  expect(a).toBe(b);")),
    "test-quality.trivial-assertion": (in_test("  assert.equal(a.b, a.b);"), in_test("  assert.equal(a.b, a.c);")),
    "test-quality.unused-mock": (in_test("  const spare = jest.fn();"), in_test("  const used = jest.fn();\n  go(used);")),
}


def _files():
    for rule, texts in CASES.items():
        for sign, files in zip("+-", texts):
            for path, text in (files if isinstance(files, dict) else {"a.ts": files}).items():
                yield f"{rule}{sign}", path, path.rsplit(".", 1)[-1] in ("ts", "js"), text, 0o755 if path == "run.js" else 0o644


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(_files()), "repo string, file_path string, is_script boolean, text string, mode int")
    got = {}
    for r in A.analyse(df).select("repo", "rule_id").distinct().collect():
        got.setdefault(r.repo, set()).add(r.rule_id)
    return got


def test_every_rule_has_cases():
    assert set(CASES) == set(RULES)


@pytest.mark.parametrize("rule", sorted(CASES))
def test_rule(found, rule):
    assert rule in found.get(f"{rule}+", ()) and rule not in found.get(f"{rule}-", ())


# Anchors of findings that baselines hold on to. Fixed values.
STABLE = {"security.eval-call": "9597745a32e48f52", "size.parameter-count": "d616356804967e11", "test-quality.no-assertions": "abc482609c475b4f", "modernisation.public-property": "c80058bf4fd46024"}
BAD = """export class Bad {
  public name = "demo";
  public process(a: boolean, b: string[], c: string, d: string, e: string, f: string, g: string, h: string): void {
    if (a) {
      eval(c);
    }
    console.log(b, d, e, f, g, h);
  }
}

test("sleeps without assertion", async () => {
  await new Promise((resolve) => setTimeout(resolve, 1));
});
"""


def test_fingerprints_stay(spark):
    df = spark.createDataFrame([("r", "bad.ts", True, BAD, 0o644)], "repo string, file_path string, is_script boolean, text string, mode int")
    got = {r.rule_id: r.fingerprint for r in A.analyse(df).collect()}
    assert {rule: got.get(rule) for rule in STABLE} == STABLE


PLANTED = {"c/a.ts": "import { b } from './b';\nexport * from '../d';", "c/b.ts": "import './a.js';\nimport type { X } from './e';", "d/index.ts": "import {\n  b,\n} from '../c/b';\nimport y from 'y';", "c/e.ts": "import '../c/a'; // './b'", "f.ts": "import './f';"}


@pytest.mark.parametrize("query,least", [("line_rules", 20), ("secret_rules", 10), ("block_rules", 20), ("file_rules", 15), ("import_edges", 8), ("import_cycles", 3)])
def test_rules_agree_with_sql_on_the_cases(spark, tmp_path_factory, query, least):
    """The tables of the cases' files, lines and blocks, held by each query and its SQL against each other."""
    folder = str(tmp_path_factory.mktemp("cases"))
    rows = [(i, *f) for i, f in enumerate([*_files(), *(("planted", path, True, text, 0o644) for path, text in PLANTED.items())])]
    files = spark.createDataFrame([(i, repo, path, script, text) for i, repo, path, script, text, _ in rows], "file_id long, repo string, file_path string, is_script boolean, text string")
    scan = A.scanned(files.selectExpr("repo", "file_path", "is_script", "text"), rules=False).join(files.select("file_id", "repo", "file_path"), ["repo", "file_path"]).cache()
    lines = A.lines_of(scan, False).unionByName(A.lines_of(scan, True).drop("code").selectExpr("*", "CAST(NULL AS STRING) AS code").where("n % 2 = 0"))
    lines.selectExpr("repo", "file_path AS display_path", "n", "line", "code AS code_line").write.parquet(f"{folder}/code_lines.parquet")
    scan.selectExpr("file_id", "file_path AS display_path", "inline(blocks)").selectExpr("monotonically_increasing_id() AS block_id", "*").write.parquet(f"{folder}/blocks.parquet")
    files.selectExpr("file_id", "repo", "file_path AS display_path", "is_script", "text", "420 AS mode", "timestamp_ntz '2025-01-01' AS ingested_at").write.parquet(f"{folder}/files.parquet")
    got = analysis.QUERIES[query](spark, folder)
    columns = sorted(got.columns)
    db = duckdb.connect()
    for name in os.listdir(folder):
        db.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{folder}/{name}/*.parquet')")
    mine = sorted(map(repr, map(tuple, got.select(*columns).collect())))
    theirs = sorted(map(repr, db.sql(f"SELECT {', '.join(columns)} FROM ({analysis.SQL[query]})").fetchall()))
    assert sorted(set(mine) - set(theirs)) == [] == sorted(set(theirs) - set(mine))
    assert mine == theirs and len(mine) >= least
