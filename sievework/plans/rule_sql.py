"""SQL of the line, secret and block rules, written from their definitions for an engine without look-around and
back-references: what these decide is put into groups that are compared, or into further conditions."""

from __future__ import annotations

NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"


def text(pattern: str) -> str:
    """A pattern as a literal of SQL."""
    return "'" + pattern.replace("'", "''") + "'"


def has(column: str, pattern: str, options: str = "c") -> str:
    return f"regexp_matches({column}, {text(pattern)}, '{options}')"


def parts(column: str, pattern: str, group: int, options: str = "c") -> str:
    return f"regexp_extract_all({column}, {text(pattern)}, {group}, '{options}')"


def part(column: str, pattern: str, group: int, options: str = "c") -> str:
    return f"regexp_extract({column}, {text(pattern)}, {group}, '{options}')"


def any_pair(column: str, pattern: str, condition: str, options: str = "c") -> str:
    """Whether a match has groups a and b for which a condition holds."""
    return f"len(list_filter(list_zip({parts(column, pattern, 1, options)}, {parts(column, pattern, 2, options)}), lambda x: {condition})) > 0"


# ---- lines

_TOKENS = r"\"(?:[^\"\\]|\\.)*(?:\"|$)|'(?:[^'\\]|\\.)*(?:'|$)|`(?:[^`\\]|\\.)*(?:`|$)|//.*|[^\"'`/]+|/"
_MASKED = f"""array_to_string(list_transform({parts('line', _TOKENS, 0)}, lambda t: CASE WHEN t LIKE '//%' THEN ''
   WHEN left(t, 1) NOT IN ('"', '''', '`') THEN t WHEN length(t) > 1 AND right(t, 1) = left(t, 1) THEN left(t, 1) || repeat(' ', length(t) - 2) || left(t, 1) ELSE left(t, 1) || repeat(' ', length(t) - 1) END), '')"""
LINES = f"l AS (SELECT repo, display_path AS file_path, n, line, coalesce(code_line, {_MASKED}) AS code FROM (SELECT DISTINCT * FROM code_lines) WHERE line IS NOT NULL)"


def _in_code(pattern: str, options: str = "c", unless: str = "") -> str:
    """Whether a match in the line begins where the code is not blank; ``unless`` follows a match that does not count."""
    front, all_, tail = (parts("line", rf"([\s\S]*?)(?:{pattern})({unless}" + (")?" if unless else ")"), g, options) for g in (1, 0, 2))
    begins = f"list_sum(list_transform({all_}[1:i], lambda t: length(t))) - length({all_}[i]) + length({front}[i]) + 1"
    return f"len(list_filter(range(1, len({all_}) + 1), lambda i: trim(substr(code, ({begins})::BIGINT, 1)) <> '' AND coalesce({tail}[i], '') = '')) > 0"


def _rows(rule_id: str, condition: str) -> str:
    return f"SELECT repo, file_path, n, '{rule_id}', NULL FROM l WHERE {condition}"


def _named(rule_id: str, names: str, condition: str = "true") -> str:
    return f"SELECT repo, file_path, n, '{rule_id}', s FROM (SELECT repo, file_path, n, unnest({names}) AS s FROM l WHERE {condition})"


_BARE = r"regexp_replace(trim(line, chr(9) || chr(10) || chr(13) || ' '), '^//+\s?', '')"
_ANCHOR = [
    r"^\s*$", r"^\s*[-=*_#]{3,}\s*$", rf"^\s*{NAME}\s*:\s*['\"`\[{{]", r"\b(?:search|grep|anchor|example|for example|e\.g\.)\s*:", r"^[A-Z][A-Za-z0-9_$]*(?:\s|\s*\([^)]*\)$)",
]
_SWITCHED_OFF = [
    rf"^(?:const|let|var)\s+{NAME}\s*=", rf"^(?:async\s+)?function\s+{NAME}\s*\(", rf"^class\s+{NAME}", rf"^interface\s+{NAME}", rf"^type\s+{NAME}\s*=", rf"^enum\s+{NAME}", r"^import\s+(?:[\"'][^\"']+[\"']|.+\s+from\s+[\"'][^\"']+[\"'])",
    r"^export\s+(?:\{|\*|(?:default\s+)?(?:const|let|var|function|class|interface|type|enum)\b)", r"^(?:if|for|while|switch)\s*\(", r"^(?:return|throw|await)\s+\S", rf"^{NAME}(?:\.{NAME})?\s*\([^)]*\);?$",
]
_NOTE = rf"^{NAME}\s+\([^;{{}}]*[A-Za-z][^;{{}}]*\)$"
_COMMENTED = f"""{has('line', r'^\s*//')} AND ({' OR '.join(has(_BARE, p) for p in _SWITCHED_OFF)}) AND NOT ({' OR '.join(has(_BARE, p) for p in _ANCHOR)}
   OR {has(_BARE, _NOTE)} AND NOT {has(_BARE, r'^(?:if|for|while|switch)\b')})"""
_TOLD = f"regexp_replace({part('line', r'@ts-(?:ignore|expect-error)\b(.*)$', 1)}, '^[-:\\s]+', '')"
_CONSOLE_FREE = f"({has('file_path', r'(?:^|/)(?:scripts|bin)/')} OR {has('file_path', r'(?:^|/)(?:cli|server)[/.]', 'i')})"
_CALL = part("code", rf"^\s*({NAME}(?:\.{NAME})*)\s*\(", 1)
_UNEQUAL = r"regexp_replace(regexp_replace(code, '[=!]==', '  ', 'g'), '\bnull\s*[=!]=|[=!]=\s*null\b', '  ', 'g')"

LINE_RULES_SQL = f"WITH {LINES}, f(repo, file_path, line, rule_id, symbol) AS (" + " UNION ALL ".join([
    _rows("security.eval-call", has("code", r"\beval\s*\(")),
    _rows("security.new-function", has("code", r"\bnew\s+Function\s*\(|(?:^|[=(:,])\s*Function\s*\(")),
    _rows("security.insecure-random", has("code", r"\bMath\.random\s*\(")),
    _rows("security.inner-html", "(" + any_pair("code", r"(\.innerHTML\s*=)(\s*(?:\"\"|''))?", "x[2] = '' OR x[2] IS NULL") + f" OR {has('code', r'\bdangerouslySetInnerHTML\b')})"),
    _rows("security.proto-access", has("code", r"\.__proto__\b")),
    _rows("security.document-write", has("code", r"\bdocument\.write\s*\(")),
    _rows("waste.redundant-boolean-cast", has("code", r"\b(?:if|while)\s*\(\s*(?:!!\s*[A-Za-z_$][A-Za-z0-9_$.]*|Boolean\s*\()")),
    _rows("security.weak-crypto", _in_code(r"\b(?:createHash|createHmac)\s*\(\s*[\"'](?:md5|sha1)[\"']|\bcreateCipher\s*\(|\b(?:secureProtocol|minVersion|maxVersion)\s*:\s*[\"'](?:SSLv2_method|SSLv3_method|TLSv1(?:_method)?|TLSv1\.1)[\"']", "i")),
    _rows("security.disabled-tls-verification", _in_code(r"\b(?:process\.env\.)?NODE_TLS_REJECT_UNAUTHORIZED\b\s*=\s*[\"']0[\"']|\brejectUnauthorized\s*:\s*false\b", "i")),
    _rows("security.javascript-url", _in_code(r"[\"'`]\s*javascript\s*:", "i", r"\s+URL\b")),
    _rows("security.proto-access", _in_code(r"\[\s*[\"']__proto__[\"']\s*\]")),
    _rows("security.sql-concatenation", _in_code(r"\b(?:query|execute|raw)\s*\(\s*(?:`[^`]*(?:SELECT|INSERT|UPDATE|DELETE)[^`]*\$\{|[\"'][^\"']*(?:SELECT|INSERT|UPDATE|DELETE)[^\"']*[\"']\s*\+)", "i")),
    _rows("modernisation.date-now-candidate", _in_code(r"\bnew\s+Date\s*\(\s*\)\s*\.getTime\s*\(\s*\)|\bNumber\s*\(\s*new\s+Date\s*\(\s*\)\s*\)")),
    _rows("modernisation.object-spread-candidate", _in_code(r"\bObject\.assign\s*\(\s*\{\s*\}\s*,")),
    _rows("waste.console-log", _in_code(r"\bconsole\.(?:log|debug)\s*\(") + f" AND NOT coalesce({_CONSOLE_FREE}, false)"),
    _rows("waste.any-type", _in_code(r":\s*any\b|as\s+any\b")),
    _rows("modernisation.var-declaration", _in_code(r"\bvar\s+[A-Za-z_$]")),
    _rows("security.async-foreach", has("code", r"\.forEach\s*\(\s*async\b")),
    _rows("security.string-timer", has("code", r"(?:^|[^.A-Za-z0-9_$])(?:setTimeout|setInterval|execScript)\s*\(\s*[\"'`]|\b(?:window|self|globalThis)\.(?:setTimeout|setInterval|execScript)\s*\(\s*[\"'`]")),
    _named("modernisation.optional-chaining-candidate", f"list_transform(list_filter(list_zip({parts('code', rf'\b({NAME})\s*&&\s*({NAME})\.{NAME}', 1)}, {parts('code', rf'\b({NAME})\s*&&\s*({NAME})\.{NAME}', 2)}), lambda x: x[1] = x[2]), lambda x: x[1])"),
    _named("modernisation.nullish-coalescing-candidate", parts("code", r"=\s*([A-Za-z_$][A-Za-z0-9_$.]*)\s*\|\|\s*(?:[\"'`]\s*[\"'`]|\d+|true|false)", 1)),
    _rows("modernisation.loose-equality", has(_UNEQUAL, "[=!]=")),
    _named("modernisation.non-null-assertion", parts("code", rf"\b({NAME}(?:\.{NAME})*)!(?:\.|\[|\)|,|;|\s+(?:as|in|instanceof)\b|\s*$)", 1)),
    _rows("modernisation.double-cast", has("code", r"\bas\s+(?:unknown|any)\s+as\s+[^;,\n]+")),
    _rows("security.throw-non-error", has(part("code", r"\bthrow\s+(.+?);?$", 1), r"^(?:[\"'`]|\d|\{|\[)")),
    _named("security.floating-promise", f"[{_CALL}]", f"({_CALL} = 'fetch' OR {has(_CALL, '(?:Async|Promise)$')}) AND NOT {has('code', r'^\s*(?:await|return|void|throw|yield)\b')} AND NOT {has('code', r'^\s*(?:const|let|var)\s')}"),
    _named("waste.exported-any", "[" + part("code", rf"\bexport\s+(?:async\s+)?(?:function|const|let|var|class|interface|type)\s+({NAME})", 1) + "]", has("code", r"\bany\b") + " AND " + has("code", rf"\bexport\s+(?:async\s+)?(?:function|const|let|var|class|interface|type)\s+{NAME}")),
    _rows("waste.commented-out-code", _COMMENTED),
    _rows("modernisation.ts-comment-without-rationale", has("line", r"@ts-(?:ignore|expect-error)\b") + f" AND len({parts(_TOLD, '[A-Za-z]{3,}', 0)}) < 3 AND NOT ({has(_TOLD, r'\b(?:because|intentional|false positive|tracked in|M\d{1,3}|ADR-\d{3}|GH-\d+)\b|\breason\s*:|https?://', 'i')} OR {has(_TOLD, r'(?:^|\s)#\d+\b')})"),
    _named("naming.hungarian-notation", parts("code", r"\b(?:const|let|var|public|private|protected)\s+((?:arr|bool|int|num|obj|str)[A-Z][A-Za-z0-9_$]*)", 1)),
]) + ") SELECT * FROM f"


# ---- secrets

_MBI = "ACDEFGHJKMNPQRTUVWXY"
_ENV = r"^\s*((?:API[_-]?KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|DATABASE_URL|DSN)|[A-Z][A-Z0-9_-]*(?:API[_-]?KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|DATABASE_URL|DSN)[A-Z0-9_-]*)\s*[:=]\s*[\"']?([^\"'\s#]+)[\"']?"
_QUOTED = r"\"([A-Za-z0-9_+=./-]{24,})\"|'([A-Za-z0-9_+=./-]{24,})'|`([A-Za-z0-9_+=./-]{24,})`"


def _values(rule_id: str, values: str) -> str:
    return f"SELECT repo, file_path, n, '{rule_id}' AS rule_id, unnest({values}) AS v FROM l"


_DIGITS = "regexp_replace(v, '[ -]', '', 'g')"
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT ELSE (substr(d, i, 1)::INT * 2) // 10 + (substr(d, i, 1)::INT * 2) % 10 END)) % 10 = 0"
_ISSUED = """(d LIKE '4%' AND length(d) IN (13, 16, 19) OR length(d) = 16 AND (left(d, 2)::INT BETWEEN 51 AND 55 OR left(d, 4)::INT BETWEEN 2221 AND 2720) OR length(d) = 15 AND left(d, 2) IN ('34', '37')
  OR length(d) IN (16, 19) AND (d LIKE '6011%' OR d LIKE '65%' OR left(d, 3)::INT BETWEEN 644 AND 649) OR length(d) = 14 AND (left(d, 3)::INT BETWEEN 300 AND 305 OR left(d, 2) IN ('36', '38', '39')) OR length(d) BETWEEN 16 AND 19 AND left(d, 4)::INT BETWEEN 3528 AND 3589)"""
_ENTROPY = "list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -(len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v)) * log2(len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v))))"
_PATH = f"({has('v', r'\.(?:md|mdx|ts|tsx|js|jsx|mjs|cjs|json|yaml|yml|toml|html|css|svg|sh)$')} AND CASE WHEN contains(v, '/') THEN {has('v', r'(?:^|/)(?:src|test|tests|fixtures?|docs|scripts|bin|workflow|package(?:-lock)?\.json)(?:/|$)')} ELSE {has('v', r'^(?:ADR-\d{3}|M\d{2,3})-[A-Za-z0-9_.-]+\.(?:md|mdx)$', 'i')} END)"

SECRET_RULES_SQL = f"WITH {LINES}, s AS (" + " UNION ALL ".join([
    _values("sensitive-data.aws-access-key", parts("line", "AKIA[0-9A-Z]{16}", 0)),
    _values("sensitive-data.private-key", parts("line", "BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY", 0)),
    _values("sensitive-data.jwt-token", parts("line", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0)),
    _values("sensitive-data.database-url-password", parts("line", r"\b(?:https?|postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|amqp|amqps|mssql)://[^/\s:@]+:[^/\s@]+@", 0)),
    _values("sensitive-data.api-key-pattern", parts("line", r"\b(?:sk_live_[A-Za-z0-9_-]{12,}|sk_test_[A-Za-z0-9_-]{12,}|sk-proj-[A-Za-z0-9_-]{16,}|sk-ant-[A-Za-z0-9_-]{16,}|ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|gh[ousr]_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|https://hooks\.slack\.com/services/[A-Za-z0-9_-]+/[A-Za-z0-9_-]+/[A-Za-z0-9_-]+|https://discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+)\b", 0)),
    _values("sensitive-data.pii-pattern", parts("line", r"\b\d{3}-\d{2}-\d{4}\b", 0)),
    _values("sensitive-data.phi-pattern", parts("line", rf"\b[1-9][{_MBI}][{_MBI}0-9]\d[{_MBI}][{_MBI}0-9]\d[{_MBI}][{_MBI}]\d\d\b", 0)),
    _values("sensitive-data.api-key-pattern", parts("line", r"(?:^|:)_authToken\s*=\s*([A-Za-z0-9_-]{20,})\b", 1) + "[1:1]"),
    _values("sensitive-data.phi-pattern", parts("line", r"\b(?:MRN|medical[\s_-]?record(?:[\s_-]?number)?)\b\s*[:=#]?\s*([0-9]{6,12})\b", 1, "i") + "[1:1]"),
    f"SELECT repo, file_path, n, rule_id, v FROM (SELECT *, {_DIGITS} AS d FROM ({_values('sensitive-data.pii-pattern', parts('line', r'\b(?:\d[ -]?){12,18}\d\b', 0))})) WHERE {_ISSUED} AND {_LUHN}",
    f"SELECT * FROM ({_values('sensitive-data.hardcoded-env-value', parts('line', _ENV, 2, 'i') + '[1:1]')}) WHERE length(v) >= 16 AND NOT {has('v', '^(?:x-api-key|token|secret|password|example|sample|placeholder)$', 'i')} AND {has('v', '[A-Za-z]')} AND {has('v', '[0-9]')}",
    f"SELECT repo, file_path, n, rule_id, trim(q, '\"''`') AS v FROM ({_values('sensitive-data.high-entropy-string', parts('line', _QUOTED, 0)).replace(' AS v ', ' AS q ')}) WHERE length(v) >= 32 AND NOT {has('v', '^[0-9a-f]+$', 'i')} AND NOT {has('v', '^sha(?:256|384|512)-[A-Za-z0-9+/=]+$')} AND NOT {_PATH} AND {has('v', '[a-z]')} AND {has('v', '[A-Z]')} AND {has('v', '[0-9]')} AND len(list_distinct(string_split(v, ''))) >= least(12, ceil(length(v) / 3)) AND {_ENTROPY} >= 4",
]) + """) SELECT repo, file_path, n AS line, rule_id, to_json({'preview': CASE WHEN length(v) <= 8 THEN repeat('*', length(v)) ELSE left(v, 4) || '...' || right(v, 4) END || ' (redacted, ' || length(v) || ' chars)'})::VARCHAR AS metadata_json FROM s"""


# ---- blocks

_ASSERTION = r"\bassert(?:\.[A-Za-z]+|[A-Z][A-Za-z0-9_$]*)?\s*\(|\bexpect(?:\.(?:assertions|hasAssertions)|[A-Z][A-Za-z0-9_$]*)?\s*\(|\b[A-Za-z_$][A-Za-z0-9_$]*Check\s*\(|\.(?:rejects|resolves)\b|\b(?:doesNotReject|rejects)\s*\("
_BLANK = "chr(9) || chr(10) || chr(13) || ' '"


def _without(*patterns: str) -> str:
    out = "code"
    for p in patterns:
        out = f"regexp_replace({out}, {text(p)}, '', 'g')"
    return out


def _block(rule_id: str, condition: str) -> str:
    return f"SELECT repo, file_path, start_line, '{rule_id}', name FROM b WHERE {condition}"


_PARAMETERS = f"list_filter(list_transform(string_split(par, ','), lambda p: trim(regexp_extract(regexp_replace(regexp_replace(trim(p, {_BLANK}), '^(?:public|private|protected|readonly)\\s+', ''), '^\\.\\.\\.', ''), '^[^?:=]*'), {_BLANK})), lambda p: {has('p', f'^{NAME}$')})"
_NESTING = "(SELECT greatest(max(s) - 1, 0) FROM (SELECT d - least(min(d) OVER (ORDER BY i), 0) AS s FROM (SELECT i, sum(CASE WHEN c = '{' THEN 1 ELSE -1 END) OVER (ORDER BY i) AS d FROM (SELECT unnest(range(1, length(m) + 1)) AS i, substr(m, i, 1) AS c FROM (SELECT regexp_replace(code, '[^{}]', '', 'g') AS m)))))"
_NUMBER = "NOT (x[2]::DOUBLE = floor(x[2]::DOUBLE) AND x[2]::DOUBLE BETWEEN -1 AND 3) AND NOT (x[2]::DOUBLE = floor(x[2]::DOUBLE) AND x[2]::DOUBLE BETWEEN 100 AND 599 AND " + has("x[1]", r"\b(?:status|statusCode)\b") + ")"
_SAME = f"regexp_replace(trim(x[1], {_BLANK}), ';$', '') = regexp_replace(trim(x[2], {_BLANK}), ';$', '')"
_SHOWN = f"list_filter(list_transform(string_split(code, chr(10)), lambda x: trim(x, {_BLANK})), lambda x: x <> '' AND x NOT LIKE '//%' AND x NOT LIKE '/*%' AND x NOT LIKE '*%')[1]"
_BODILESS = f"coalesce({has(_SHOWN, r'\)[^{;]*;\s*$')}, false)"
_LAST = f"list_filter(list_transform(range(1, len(string_split(code, chr(10))) + 1), lambda i: {{'i': i - 1, 't': trim(string_split(code, chr(10))[i], {_BLANK})}}), lambda x: x.t NOT IN ('', '}}'))[-1]"
_SETUP_LINES = f"list_filter(list_transform(string_split(body_code, chr(10)), lambda x: trim(x, {_BLANK})), lambda x: x NOT IN ('', '}}', '}});'))"
_SETUP = f"(SELECT CASE WHEN p > 0 THEN p - 1 ELSE k END FROM (SELECT coalesce(list_position(list_transform(u, lambda x: {has('x', _ASSERTION)}), true), 0) AS p, len(u) AS k FROM (SELECT {_SETUP_LINES} AS u)))"
_MOCKS = parts("code", rf"\bconst\s+({NAME})\s*=\s*(?:(?:vi|jest)\.fn|sinon\.stub|createMock|mock)\s*\(", 1)
_EXPECTED = parts("code", rf"\bexpect\s*\(\s*({NAME})\s*\)", 1)
_IN_TESTS = f"coalesce({has('file_path', r'(?:^|/)(?:__tests__|tests?|spec|__fixtures__|fixtures?|testdata)/|\.(?:test|spec)\.[cm]?[tj]sx?$')}, false)"

BLOCK_RULES_SQL = f"""WITH r AS (SELECT DISTINCT file_id, repo FROM files), q AS (SELECT DISTINCT * FROM blocks),
a AS (SELECT repo, display_path AS file_path, coalesce(code_body, body) AS code, body, name, coalesce(name, '') AS title, coalesce(params, '') AS par, start_line, line_count, declaration_line,
   coalesce(is_test, false) AS test, coalesce(has_leading_comment, false) AS commented, coalesce(is_exported, false) AS exported FROM q JOIN r USING (file_id) WHERE body IS NOT NULL),
c AS (SELECT *, CASE WHEN contains(code, '{{') AND contains(code, '}}') AND length(code) - position('}}' IN reverse(code)) + 1 > position('{{' IN code) THEN substr(code, position('{{' IN code) + 1, length(code) - position('}}' IN reverse(code)) - position('{{' IN code))
   WHEN contains(code, '=>') THEN regexp_replace(substr(code, position('=>' IN code) + 2), ';?\\s*$', '') ELSE '' END AS body_code,
   1 + len({parts('code', r'\b(?:if|switch|case|for|while|catch)\b', 0)}) + length(code) - length(replace(code, '?', '')) + len({parts('code', '&&', 0)}) + len({parts('code', r'\|\|', 0)}) AS cyclo FROM a),
b AS (SELECT *, coalesce({_NESTING}, 0) AS deep, {_SETUP} AS setup, {_PARAMETERS} AS names FROM c),
f(repo, file_path, line, rule_id, symbol) AS (""" + " UNION ALL ".join([
    _block("size.function-length", "line_count > 200"), _block("size.parameter-count", "len(list_filter(string_split(par, ','), lambda p: trim(p) <> '')) > 7"), _block("complexity.cyclomatic", "cyclo > 15"), _block("complexity.cognitive", "cyclo + deep > 15"),
    _block("naming.generic-function", "lower(title) IN ('process', 'handle', 'doit', 'run', 'execute', 'manage')"), _block("docs.missing-exported-function-doc", "NOT test AND exported AND NOT commented"), _block("docs.missing-internal-function-doc", "NOT test AND NOT exported AND NOT commented"),
    _block("waste.empty-function", f"trim(regexp_replace(regexp_replace(body_code, '//.*', '', 'g'), '/\\*[\\s\\S]*?\\*/', '', 'g'), {_BLANK}) = '' AND NOT coalesce(file_path LIKE '%.d.ts', false) AND NOT {_BODILESS} AND NOT ({_IN_TESTS} AND {has('body', '//|/[*]')} AND {has('body', r'\b(?:intentional no-op|test double|stub|fake|interface contract)\b', 'i')})"),
    _block("test-quality.no-assertions", f"test AND NOT {has('code', _ASSERTION)}"),
    _block("test-quality.trivial-assertion", f"test AND ({has('code', r'\bassert\.ok\s*\(\s*true\s*\)')} OR {any_pair('code', r'\bassert\.(?:equal|strictEqual|deepEqual)\s*\(\s*([^,\n]+?)\s*,\s*([^,\n)]+?)(?:\s*,|\s*\))', _SAME)} OR {any_pair('code', r'\bexpect\s*\(\s*([^)]+?)\s*\)\s*\.\s*to(?:Be|Equal|StrictEqual)\s*\(\s*([^)]+?)\s*\)', _SAME)})"),
    _block("test-quality.snapshot-only-test", f"test AND {has('code', r'\.\s*toMatch(?:Inline)?Snapshot\s*\(')} AND NOT {has(_without(r'\bexpect\s*\([\s\S]*?\)\s*\.\s*toMatch(?:Inline)?Snapshot\s*\([^)]*\)\s*;?', r'\bexpect\.(?:assertions|hasAssertions)\s*\([^)]*\)\s*;?'), _ASSERTION)}"),
    _block("test-quality.no-throw-only-test", f"test AND {has('code', r'\bassert\.doesNotThrow\s*\(|\.\s*not\s*\.\s*toThrow\s*\(')} AND NOT {has(_without(r'\bassert\.doesNotThrow\s*\([\s\S]*?\)\s*;?', r'\bexpect\s*\([\s\S]*?\)\s*\.\s*not\s*\.\s*toThrow\s*\([^)]*\)\s*;?', r'\bexpect\.(?:assertions|hasAssertions)\s*\([^)]*\)\s*;?'), _ASSERTION)}"),
    _block("test-quality.exception-type-only", "test AND " + has("code", r"\.toThrow\s*\(\s*(?:Error|[A-Z][A-Za-z0-9_$]*Error)\s*\)|\bassert\.throws\s*\([^,\n]+,\s*(?:Error|[A-Z][A-Za-z0-9_$]*Error)\s*\)")),
    _block("test-quality.magic-number-assertion", f"test AND ({any_pair('code', r'\bexpect\s*\(\s*([^)]+?)\s*\)\s*\.\s*to(?:Be|Equal)\s*\(\s*(-?\d+(?:\.\d+)?)\s*\)', _NUMBER)} OR {any_pair('code', r'\bassert\.(?:equal|strictEqual|deepEqual)\s*\(\s*([^,\n]+?)\s*,\s*(-?\d+(?:\.\d+)?)(?:\s*,|\s*\))', _NUMBER)}) AND NOT {has('title', r'\b(?:constant|threshold|limit|budget|default|contract)\b', 'i')}"),
    _block("test-quality.mock-only-test", f"test AND {has('code', r'\b(?:vi|jest)\.fn\s*\(|\b(?:createMock|mock|sinon\.stub)\s*\(')} AND {has('code', r'\.(?:toHaveBeenCalled|toHaveBeenCalledWith|toHaveBeenNthCalledWith|toBeCalled|toBeCalledWith)\s*\(')} AND len({_EXPECTED}) > 0 AND len(list_filter({_EXPECTED}, lambda t: NOT {has('t', '(?:mock|stub|spy)$', 'i')})) = 0"),
    _block("test-quality.global-state-mutation", "test AND " + has("code", r"\bprocess\.env\.[A-Za-z0-9_]+\s*=|\bglobalThis\.[A-Za-z0-9_$]+\s*=|\b(?:Date\.now|Math\.random)\s*=")),
    _block("test-quality.setup-bloat", f"test AND setup > CASE WHEN coalesce({has('file_path', r'(?:^|/)test/(?:integration|contract|smoke|performance)/')}, false) THEN 24 ELSE 12 END"),
    _block("test-quality.sleep-in-test", "test AND " + has("code", r"\b(?:setTimeout|sleep|waitForTimeout)\s*\(")), _block("test-quality.only-skip", "test AND " + has("code", r"\.(?:only|skip)\s*\(")),
    f"SELECT repo, file_path, start_line, 'waste.unused-parameter', name FROM (SELECT *, unnest(names) AS p FROM b WHERE NOT coalesce(file_path LIKE '%.d.ts', false) AND NOT {_BODILESS}) WHERE p NOT LIKE '\\_%' ESCAPE '\\' AND NOT regexp_matches(body_code, '(?:^|[^A-Za-z0-9_])' || replace(p, '$', '\\$') || '(?:[^A-Za-z0-9_]|$)') AND NOT regexp_matches(body, '\\$\\{{[^}}]*\\b' || replace(p, '$', '\\$') || '\\b[^}}]*\\}}')",
    f"SELECT repo, file_path, start_line, 'test-quality.unused-mock', name FROM (SELECT *, unnest({_MOCKS}) AS p FROM b WHERE test) WHERE len(regexp_extract_all(code, '\\b' || replace(p, '$', '\\$') || '\\b')) <= 1",
    "SELECT repo, file_path, declaration_line, 'naming.generic-parameter', p FROM (SELECT *, unnest(names) AS p FROM b WHERE len(names) >= 3 OR line_count >= 30 OR cyclo >= 8) WHERE lower(p) IN ('foo', 'bar', 'baz', 'tmp', 'temp', 'thing', 'stuff', 'data', 'value', 'item')",
    f"""SELECT repo, file_path, start_line + length(front) - length(replace(front, chr(10), '')), 'waste.redundant-variable', x FROM
        (SELECT *, array_to_string(t[1:k - 1], ';') || CASE WHEN k > 1 THEN ';' ELSE '' END || regexp_extract(t[k], '([\\s\\S]*?)\\b(?:const|let)\\s+' || replace(x, '$', '\\$') || '\\s*=', 1) AS front FROM
        (SELECT *, {part('t[k + 1]', rf'^[\s]*return\s+({NAME})\s*$', 1)} AS x FROM (SELECT *, unnest(range(1, len(t))) AS k FROM (SELECT *, string_split(code, ';') AS t FROM b)))
        WHERE x <> '' AND k + 1 < len(t) AND regexp_matches(t[k], '\\b(?:const|let)\\s+' || replace(x, '$', '\\$') || '\\s*=[\\s\\S]'))""",
    f"SELECT repo, file_path, start_line + z.i, 'waste.useless-return', name FROM (SELECT *, {_LAST} AS z FROM b) WHERE {has('z.t', r'^return\s*;?$')}",
]) + ") SELECT * FROM f"


# ---- files: rules that raw text decides

_EXPORT = rf"/\*\*((?:[^*]|\*+[^*/])*)\*+/\s*export\s+function\s+({NAME})\s*\(([^)]*)\)(?:\s*:\s*([^{{\n]+))?"
_TAGS = f"list_filter(list_transform(string_split(doc, chr(10)), lambda x: {part('x', rf'@param\s*(?:\{{[^}}]*\}}\s*)?({NAME})', 1)}), lambda x: x <> '')"
_COMMENT_LINES = r"list_filter(list_transform(string_split(regexp_extract(c, '^/\*([\s\S]*?)\*/', 1), chr(10)), lambda x: trim(regexp_replace(x, '^\s*\*\s?', ''), chr(9) || chr(13) || ' ')), lambda x: x <> '' AND x NOT LIKE '@%')"
_NO_COMMENTS = r"""regexp_replace(regexp_replace(regexp_replace(text, '^\x{FEFF}', ''), '("(?:[^"\\\n]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', '\1', 'g'), ',(\s*[}\]])', '\1', 'g')"""


def _key_line(key: str) -> str:
    """The line on which a key of a document stands first, 1 if it does not."""
    return f"(1 + coalesce(length(regexp_extract(text, '([\\s\\S]*?)\"' || {key} || '\"\\s*:', 1)) - length(replace(regexp_extract(text, '([\\s\\S]*?)\"' || {key} || '\"\\s*:', 1), chr(10), '')), 0))"


def _setting(flag: str, rule_id: str) -> str:
    on = f"json_extract(j, '$.compilerOptions.{flag}')"
    return f"SELECT repo, file_path, {_key_line(repr(flag))}, '{rule_id}', '{flag}' FROM j WHERE {has('file_path', r'(?:^|/)tsconfig(?:\.[^./]+)*\.json$')} AND coalesce({on}::VARCHAR, '') <> 'true' AND NOT ({on} IS NULL AND json_extract(j, '$.extends') IS NOT NULL)"


def _entries(section: str) -> str:
    return f"SELECT repo, file_path, text, unnest(json_keys(j, '$.{section}')) AS k, '{section}' AS s, j FROM j WHERE {has('file_path', r'(?:^|/)package\.json$')} AND json_type(j, '$.{section}') = 'OBJECT'"


_VALUE = "json_extract_string(json_extract(j, '$.' || s), '$.\"' || k || '\"')"
_URL_SPEC = r"^(?:https?://|git(?:\+https?|\+ssh)?://|ssh://|github:|gitlab:|bitbucket:|file:|git@[^:]+:[^/]+/|[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(?:#.+)?$)"
_PLAIN = "lower(trim(v))"

FILE_RULES = (
    "docs.missing-file-overview", "docs.missing-param-tag", "docs.missing-return-tag", "docs.stale-param-tag", "size.file-length", "modernisation.tsconfig-strict-disabled", "modernisation.tsconfig-index-safety-disabled", "modernisation.tsconfig-exact-optional-disabled",
    "security.remote-install-script", "security.risky-lifecycle-script", "security.url-dependency", "waste.broad-runtime-version",
)
FILE_RULES_SQL = f"""WITH f AS (SELECT repo, display_path AS file_path, is_script, text FROM files QUALIFY row_number() OVER (PARTITION BY repo, display_path ORDER BY ingested_at DESC, file_id DESC) = 1),
h AS (SELECT *, CASE WHEN b LIKE '#!%' THEN regexp_replace(regexp_replace(b, '^[^\\n]*', ''), '^\\s*', '') ELSE b END AS c FROM (SELECT *, regexp_replace(regexp_replace(text, '^\\x{{FEFF}}', ''), '^\\s*', '') AS b FROM f WHERE is_script AND text IS NOT NULL)),
x AS (SELECT repo, file_path, text, unnest({parts('text', _EXPORT, 0)}) AS whole, unnest({parts('text', _EXPORT, 1)}) AS doc, unnest({parts('text', _EXPORT, 2)}) AS name, unnest({parts('text', _EXPORT, 3)}) AS par, unnest({parts('text', _EXPORT, 4)}) AS returns FROM f WHERE is_script),
d AS (SELECT *, 1 + length(front) - length(replace(front, chr(10), '')) AS line, {_PARAMETERS} AS names, {_TAGS} AS tags, trim(coalesce(returns, ''), {_BLANK}) AS kind FROM (SELECT *, substr(text, 1, position(whole IN text) - 1) AS front FROM x)),
j AS (SELECT repo, file_path, text, t::JSON AS j FROM (SELECT *, {_NO_COMMENTS} AS t FROM f WHERE NOT is_script AND file_path LIKE '%.json' AND text IS NOT NULL) WHERE json_valid(t) AND json_type(t) = 'OBJECT'),
s AS (SELECT *, {_VALUE} AS v FROM ({_entries('scripts')})),
p AS (SELECT *, {_VALUE} AS v FROM ({' UNION ALL '.join(_entries(x) for x in ('dependencies', 'devDependencies', 'optionalDependencies', 'peerDependencies'))})),
r(repo, file_path, line, rule_id, symbol) AS (""" + " UNION ALL ".join([
    f"SELECT repo, file_path, 1, 'docs.missing-file-overview', NULL FROM h WHERE NOT ({has('c', r'^//[ \t]*[^\s]')} OR c LIKE '/*%' AND len({_COMMENT_LINES}) > 0)",
    "SELECT repo, file_path, line, 'docs.missing-param-tag', name FROM d WHERE len(list_filter(names, lambda n: NOT list_contains(tags, n))) > 0",
    "SELECT repo, file_path, line, 'docs.stale-param-tag', name FROM d WHERE len(list_filter(tags, lambda t: NOT list_contains(names, t))) > 0",
    f"SELECT repo, file_path, line, 'docs.missing-return-tag', name FROM d WHERE kind <> '' AND NOT {has('kind', r'^void\b')} AND NOT {has('doc', r'@returns?\b')}",
    "SELECT repo, file_path, 1, 'size.file-length', NULL FROM f WHERE length(text) - length(replace(text, chr(10), '')) + 1 > 750 AND regexp_extract(file_path, '[^/]*$') NOT IN ('package-lock.json', 'npm-shrinkwrap.json', 'yarn.lock', 'pnpm-lock.yaml', 'bun.lockb')",
    _setting("strict", "modernisation.tsconfig-strict-disabled"), _setting("noUncheckedIndexedAccess", "modernisation.tsconfig-index-safety-disabled"), _setting("exactOptionalPropertyTypes", "modernisation.tsconfig-exact-optional-disabled"),
    f"SELECT repo, file_path, {_key_line('k')}, 'security.remote-install-script', k FROM s WHERE {has('v', r'\b(?:curl|wget)\b[^\n|;&]*https?://[^\n|;&]*\|\s*(?:sudo\s+)?(?:sh|bash|zsh)\b', 'i')}",
    f"SELECT repo, file_path, {_key_line('k')}, 'security.risky-lifecycle-script', k FROM s WHERE k IN ('preinstall', 'install', 'postinstall', 'prepare', 'prepublish', 'prepublishOnly')",
    f"SELECT DISTINCT repo, file_path, {_key_line('k')}, 'security.url-dependency', k FROM p WHERE {has('v', _URL_SPEC, 'i')}",
    f"SELECT DISTINCT repo, file_path, {_key_line('k')}, 'waste.broad-runtime-version', k FROM p WHERE s IN ('dependencies', 'optionalDependencies') AND ({_PLAIN} IN ('*', 'x', 'latest') OR {has(_PLAIN, r'^>=\s*\d')} AND {_PLAIN} NOT LIKE '%<%' OR {_PLAIN} LIKE '%||%')",
]) + ") SELECT * FROM r"


# ---- imports

_STATEMENT = r"(?m)^[ \t]*((?:import|export)\b[^;\"'`]*?[\"'][^\"'\n]*[\"'])"
_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
_TRIED = f"""CASE WHEN {has('base', r'\.[^./]+$')} THEN [base, {', '.join(f"regexp_replace(base, '[.][^./]+$', '') || '.{e}'" for e in _EXTENSIONS)}]
   ELSE [{', '.join(f"base || '.{e}', base || '/index.{e}'" for e in _EXTENSIONS)}] END"""
_COLLAPSED = "array_to_string(list_reduce(list_prepend([], list_transform(list_filter(string_split(raw, '/'), lambda p: p NOT IN ('', '.')), lambda p: [p])), lambda d, p: CASE WHEN p[1] = '..' AND len(d) > 0 AND d[-1] <> '..' THEN d[1:-2] ELSE d || p END), '/')"
_EDGES = f"""f AS (SELECT repo, display_path AS file_path, is_script, text FROM files QUALIFY row_number() OVER (PARTITION BY repo, display_path ORDER BY ingested_at DESC, file_id DESC) = 1),
i AS (SELECT repo, file_path, text, unnest({parts('text', _STATEMENT, 1)}) AS statement FROM f WHERE is_script),
s AS (SELECT *, {part('statement', r"[\"']([^\"'\n]*)[\"']$", 1)} AS specifier, {has('statement', r'^(?:import|export)\s+type\b')} AS type_only, substr(text, 1, position(statement IN text) - 1) AS front FROM i),
r AS (SELECT *, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') || '/' || specifier ELSE specifier END AS raw, 1 + length(front) - length(replace(front, chr(10), '')) AS line FROM s WHERE specifier LIKE '.%'),
t AS (SELECT *, {_TRIED} AS tried FROM (SELECT *, {_COLLAPSED} AS base FROM r)),
u AS (SELECT repo, file_path AS src, specifier, line, type_only, unnest(tried) AS dst, unnest(range(1, len(tried) + 1)) AS rank FROM t),
e AS (SELECT u.repo, u.src, f.file_path AS dst, u.specifier, u.line, u.type_only FROM u JOIN f ON f.repo = u.repo AND f.file_path = u.dst
   QUALIFY row_number() OVER (PARTITION BY u.repo, u.src, u.specifier, u.line, u.type_only ORDER BY u.rank) = 1)"""
IMPORT_EDGES_SQL = f"WITH {_EDGES} SELECT * FROM e"
IMPORT_CYCLES_SQL = f"""WITH RECURSIVE {_EDGES}, g AS (SELECT DISTINCT repo, src, dst FROM e WHERE NOT type_only AND src <> dst),
w AS (SELECT repo, src AS first, dst AS last, [src, dst] AS path FROM g WHERE dst > src
      UNION ALL SELECT w.repo, first, g.dst, list_append(path, g.dst) FROM w JOIN g ON g.repo = w.repo AND g.src = w.last WHERE g.dst > first AND NOT list_contains(path, g.dst) AND len(path) < 12)
SELECT DISTINCT w.repo, array_to_string(list_sort(path), ' -> ') AS files FROM w JOIN g ON g.repo = w.repo AND g.src = w.last AND g.dst = w.first"""
