"""Rules on single lines: one scan of the lines tests all patterns at once, as built-in column expressions.

Patterns are fixed values. They are written as usual and translated by ``java``, see there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import scalars as S
from sievework.functions.patterns import java
from sievework.operators.catalog import Config


@dataclass(frozen=True)
class LineRule:
    rule_id: str
    pattern: str
    message: str
    #: "masked": the masked line; "code": the raw line, where a match has to begin in code.
    on: str = "masked"
    #: The group that is the finding's symbol, of each match; without one a line gives one finding.
    symbol: int | None = None
    #: Texts of which every match holds one, in lower case for a pattern without regard to case. They spare the pattern.
    signs: tuple[str, ...] = ()


_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
LINE_RULES = [
    LineRule("security.eval-call", r"\beval\s*\(", "Code is built at run time by eval().", signs=("eval",)),
    LineRule("security.new-function", r"\bnew\s+Function\s*\(|(?:^|[=(:,])\s*Function\s*\(", "Code is built at run time by the Function constructor.", signs=("Function",)),
    LineRule("security.insecure-random", r"\bMath\.random\s*\(", "Math.random() is no source for secrets.", signs=("Math.random",)),
    LineRule("security.inner-html", r"\.innerHTML\s*=(?!\s*(?:\"\"|''))|\bdangerouslySetInnerHTML\b", "Markup is set from code.", signs=("nerHTML",)),
    LineRule("security.proto-access", r"\.__proto__\b", "The prototype is reached directly.", signs=("__proto__",)),
    LineRule("security.document-write", r"\bdocument\.write\s*\(", "The document is written to directly.", signs=("document.write",)),
    LineRule("waste.redundant-boolean-cast", r"\b(?:if|while)\s*\(\s*(?:!!\s*[A-Za-z_$][A-Za-z0-9_$.]*|Boolean\s*\()", "A condition is cast to a boolean anyway.", signs=("!!", "Boolean")),
    LineRule("security.weak-crypto", r"(?i)\b(?:createHash|createHmac)\s*\(\s*[\"'](?:md5|sha1)[\"']|\bcreateCipher\s*\(|\b(?:secureProtocol|minVersion|maxVersion)\s*:\s*[\"'](?:SSLv2_method|SSLv3_method|TLSv1(?:_method)?|TLSv1\.1)[\"']", "A broken algorithm or protocol is asked for.", "code", signs=("createh", "createcipher", "secureprotocol", "minversion", "maxversion")),
    LineRule("security.disabled-tls-verification", r"(?i)\b(?:process\.env\.)?NODE_TLS_REJECT_UNAUTHORIZED\b\s*=\s*[\"']0[\"']|\brejectUnauthorized\s*:\s*false\b", "Certificates are not checked.", "code", signs=("reject",)),
    LineRule("security.javascript-url", r"(?i)[\"'`]\s*javascript\s*:(?!\s+URL\b)", "A URL holds script.", "code", signs=("javascript",)),
    LineRule("security.proto-access", r"\[\s*[\"']__proto__[\"']\s*\]", "The prototype is reached by its name.", "code", signs=("__proto__",)),
    LineRule("security.sql-concatenation", r"(?i)\b(?:query|execute|raw)\s*\(\s*(?:`[^`]*(?:SELECT|INSERT|UPDATE|DELETE)[^`]*\$\{|[\"'][^\"']*(?:SELECT|INSERT|UPDATE|DELETE)[^\"']*[\"']\s*\+)", "A statement is put together from text.", "code", signs=("query", "execute", "raw")),
    LineRule("modernisation.date-now-candidate", r"\bnew\s+Date\s*\(\s*\)\s*\.getTime\s*\(\s*\)|\bNumber\s*\(\s*new\s+Date\s*\(\s*\)\s*\)", "Date.now() says the same.", "code", signs=("Date",)),
    LineRule("modernisation.object-spread-candidate", r"\bObject\.assign\s*\(\s*\{\s*\}\s*,", "A spread says the same.", "code", signs=("Object.assign",)),
    LineRule("waste.console-log", r"\bconsole\.(?:log|debug)\s*\(", "A line writes to the console.", "code", signs=("console.",)),
    LineRule("waste.any-type", r":\s*any\b|as\s+any\b", "The type any switches checks off.", "code", signs=("any",)),
    LineRule("modernisation.var-declaration", r"\bvar\s+[A-Za-z_$]", "A var could be let or const.", "code", signs=("var",)),
    LineRule("security.async-foreach", r"\.forEach\s*\(\s*async\b", "forEach does not wait for its callback.", signs=(".forEach",)),
    LineRule("security.string-timer", r"(?:^|[^.A-Za-z0-9_$])(?:setTimeout|setInterval|execScript)\s*\(\s*[\"'`]|\b(?:window|self|globalThis)\.(?:setTimeout|setInterval|execScript)\s*\(\s*[\"'`]", "A timer is given text.", signs=("setTimeout", "setInterval", "execScript")),
    LineRule("modernisation.optional-chaining-candidate", rf"\b({_NAME})\s*&&\s*\1\.{_NAME}", "Optional chaining says the same.", symbol=1, signs=("&&",)),
    LineRule("modernisation.nullish-coalescing-candidate", r"=\s*([A-Za-z_$][A-Za-z0-9_$.]*)\s*\|\|\s*(?:[\"'`]\s*[\"'`]|\d+|true|false)", "?? may be meant.", symbol=1, signs=("||",)),
    LineRule("modernisation.loose-equality", r"(?=[=!]=)(?<![=!])(?<!\bnull\s{0,20})[=!]=(?!=)(?!\s*null\b)", "A comparison converts types.", signs=("==", "!=")),
    LineRule("modernisation.non-null-assertion", rf"\b({_NAME}(?:\.{_NAME})*)!(?=\.|\[|\)|,|;|\s+(?:as|in|instanceof)\b|\s*$)", "A null check is waived.", symbol=1, signs=("!",)),
    LineRule("modernisation.double-cast", r"\bas\s+(?:unknown|any)\s+as\s+[^;,\n]+", "A cast goes by way of another type.", signs=("unknown", "any")),
    LineRule("security.throw-non-error", r"^(?:(?!\bthrow\s).)*\bthrow\s+(?:[\"'`]|\d|\{|\[)", "What is thrown is no error.", signs=("throw",)),
    LineRule("security.floating-promise", rf"^\s*(?!(?:await|return|void|throw|yield)\b)(?!(?:const|let|var)\s)(fetch|(?:{_NAME}\.)*[A-Za-z0-9_$]*(?:Async|Promise))\s*\(", "Nobody waits for a promise.", symbol=1, signs=("fetch", "Async", "Promise")),
    LineRule("waste.exported-any", rf"^(?=.*\bany\b).*?\bexport\s+(?:async\s+)?(?:function|const|let|var|class|interface|type)\s+({_NAME})", "An exported declaration uses any.", symbol=1, signs=("export",)),
]
_CONSOLE_FREE = r"(?:^|/)(?:scripts|bin)/|(?i:(?:^|/)(?:cli|server)[/.])"
_TRUST = r"(?i)\b(?:trust boundary|external input|wire format|parser boundary|TS2352|unknown hop|validated|narrowed|type guard|schema)\b"
_RATIONALE = r"(?i)\b(?:because|intentional|false positive|tracked in|M\d{1,3}|ADR-\d{3}|GH-\d+)\b|\breason\s*:|(?:^|\s)#\d+\b|https?://"
_DIRECTIVE = r"@ts-(?:ignore|expect-error)\b(.*)$"
# A line comment, and what it must and must not say to be code that is switched off.
_COMMENTED = r"^\s*//+\s?"
_STATEMENT = (
    r"(?:(?:const|let|var)\s+[A-Za-z_$][A-Za-z0-9_$]*\s*=|(?:async\s+)?function\s+[A-Za-z_$][A-Za-z0-9_$]*\s*\(|class\s+[A-Za-z_$][A-Za-z0-9_$]*|interface\s+[A-Za-z_$][A-Za-z0-9_$]*|type\s+[A-Za-z_$][A-Za-z0-9_$]*\s*=|enum\s+[A-Za-z_$][A-Za-z0-9_$]*"
    r"|import\s+(?:[\"'][^\"']+[\"']|.+\s+from\s+[\"'][^\"']+[\"'])|export\s+(?:\{|\*|(?:default\s+)?(?:const|let|var|function|class|interface|type|enum)\b)|(?:if|for|while|switch)\s*\(|(?:return|throw|await)\s+\S|[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)?\s*\([^)]*\);?\s*$)"
)
_PROSE = r"\s*$|[-=*_#]{3,}\s*$|\s*[A-Za-z_$][A-Za-z0-9_$]*\s*:\s*['\"`\[{]|.*\b(?:search|grep|anchor|example|for example|e\.g\.)\s*:|\s*(?!(?:if|for|while|switch)\b)[A-Za-z_$][A-Za-z0-9_$]*\s+\([^;{}]*[A-Za-z][^;{}]*\)\s*$|\s*[A-Z][A-Za-z0-9_$]*(?:\s+\S|\s*\([^)]*\)\s*$)"
_LITERALS = r"\"(?:[^\"\\]|\\.)*(?:\"|$)|'(?:[^'\\]|\\.)*(?:'|$)|`(?:[^`\\]|\\.)*(?:`|$)|//.*|[^\"'`/]+|/"


def code_line(line: Column) -> Column:
    """A line by itself as code: the bodies of its literals blank, and cut off at a line comment."""
    token = F.regexp_extract_all(line, F.lit(f"(?:{_LITERALS})"), F.lit(0))
    quoted = lambda t: F.left(t, F.lit(1)).isin('"', "'", "`")
    closed = lambda t: (F.length(t) > 1) & (F.right(t, F.lit(1)) == F.left(t, F.lit(1)))
    blank = lambda t: F.concat(F.left(t, F.lit(1)), F.repeat(F.lit(" "), F.length(t) - F.when(closed(t), 2).otherwise(1)), F.when(closed(t), F.left(t, F.lit(1))).otherwise(""))
    return F.array_join(F.transform(token, lambda t: F.when(t.startswith("//"), "").when(quoted(t), blank(t)).otherwise(t)), "")


def _starts_in_code(pattern: str) -> Column:
    """Whether one of the matches in the raw line begins with what is not blank in the masked line.

    Matches and what stands in front of each are taken in turn, so that one in a comment or a text hides no later one.
    """
    flags = pattern[:4] if pattern.startswith("(?i)") else ""
    bare = pattern[len(flags) :]
    part = lambda i: F.regexp_extract_all("line", F.lit(f"{flags}\\G([\\s\\S]*?)(?:{bare})"), F.lit(i))
    matches = F.arrays_zip(part(0).alias("all"), part(1).alias("front"))
    at_code = lambda at: F.trim(F.substring(F.col("code"), at, F.lit(1))) != ""
    walked = F.aggregate(matches, F.struct(F.lit(1).alias("at"), F.lit(False).alias("hit")), lambda s, m: F.struct((s["at"] + F.length(m["all"])).alias("at"), (s["hit"] | at_code(s["at"] + F.length(m["front"]))).alias("hit")), lambda s: s["hit"])
    return F.when(F.col("line").rlike(pattern), walked).otherwise(False)


def _signed(rule: LineRule) -> Column:
    """Whether a line holds one of the texts without which the rule's pattern cannot match."""
    column = F.col("code" if rule.on == "masked" else "line")
    column = F.lower(column) if rule.pattern.startswith("(?i)") else column
    out = column.contains(rule.signs[0])
    for sign in rule.signs[1:]:
        out = out | column.contains(sign)
    return F.coalesce(out, F.lit(False))


#: What a rule yields for a line or block.
YIELD = "array<struct<rule_id:string,line:int,symbol:string,message:string,severity:string,metadata_json:string>>"


def line_yields(config: Config = Config()) -> Column:
    """What all line rules yield for one line: of its columns line, code (masked; null: see :func:`code_line`), n and
    file_path. Nothing for a null line."""
    none = F.lit(None).cast("string")
    row = lambda rule, symbol, severity=none: F.struct(F.lit(rule.rule_id).alias("rule_id"), F.col("n").cast("int").alias("line"), symbol.alias("symbol"), F.lit(rule.message).alias("message"), severity.alias("severity"), none.alias("metadata_json"))
    once = lambda hit, *args: F.when(F.coalesce(hit, F.lit(False)), F.array(row(*args))).otherwise(F.array().cast(YIELD))
    each = lambda pattern, group, rule: F.transform(F.regexp_extract_all("code", F.lit(pattern), F.lit(group)), lambda s: row(rule, s))
    found = []
    for rule in LINE_RULES:
        if not config.enabled(rule.rule_id):
            continue
        pattern = java(rule.pattern)
        if rule.symbol:
            found.append(F.when(_signed(rule), each(pattern, rule.symbol, rule)).otherwise(F.array().cast(YIELD)))
            continue
        hit, severity = _signed(rule) & (F.col("code").rlike(pattern) if rule.on == "masked" else _starts_in_code(pattern)), none
        if rule.rule_id == "waste.console-log":
            hit = hit & ~F.coalesce(F.col("file_path").rlike(_CONSOLE_FREE), F.lit(False))
        if rule.rule_id == "modernisation.double-cast":
            severity = F.when(F.col("line").rlike(r"//|/\*") & F.col("line").rlike(java(_TRUST)), "advisory")
        found.append(once(hit, rule, none, severity))
    if config.enabled("waste.commented-out-code"):
        rule = LineRule("waste.commented-out-code", "", "A comment holds code.")
        found.append(once(F.col("line").contains("//") & F.col("line").rlike(java(_COMMENTED + _STATEMENT)) & ~F.col("line").rlike(java(f"{_COMMENTED}(?:{_PROSE})")), rule, none))
    if config.enabled("modernisation.ts-comment-without-rationale"):
        rule = LineRule("modernisation.ts-comment-without-rationale", "", "A check is switched off without a reason.")
        told = F.regexp_replace(F.regexp_extract("line", java(_DIRECTIVE), 1), java(r"^[-:\s]+"), "")
        words = F.regexp_count(told, F.lit("[A-Za-z]{3,}"))
        found.append(once(F.col("line").contains("@ts-") & F.col("line").rlike(java(_DIRECTIVE)) & (words < 3) & ~told.rlike(java(_RATIONALE)), rule, none))
    if config.enabled("naming.hungarian-notation") and config.hungarian_prefixes:
        pattern = r"\b(?:const|let|var|public|private|protected)\s+((?:" + "|".join(sorted(config.hungarian_prefixes)) + r")[A-Z][A-Za-z0-9_$]*)"
        found.append(each(java(pattern), 1, LineRule("naming.hungarian-notation", "", "A name begins with its type.")))
    return F.concat(F.array().cast(YIELD), *found)


def line_findings(lines: DataFrame, config: Config = Config()) -> DataFrame:
    """Findings of all line rules in one pass. ``lines``: repo, file_path, n, line, code (see :func:`line_yields`).

    Lines are only filtered and projected, so nothing is shuffled; null lines give nothing.
    """
    source = lines.where(F.col("line").isNotNull()).withColumn("code", F.coalesce("code", code_line(F.col("line"))))
    return source.select("repo", "file_path", F.inline(line_yields(config)))


# ---- secrets: on the raw text of every file

_MBI = "ACDEFGHJKMNPQRTUVWXY"
SECRETS = [
    ("sensitive-data.aws-access-key", r"AKIA[0-9A-Z]{16}"),
    ("sensitive-data.private-key", r"BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY"),
    ("sensitive-data.jwt-token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("sensitive-data.database-url-password", r"\b(?:https?|postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|amqp|amqps|mssql)://[^/\s:@]+:[^/\s@]+@"),
    ("sensitive-data.api-key-pattern", r"\b(?:sk_live_[A-Za-z0-9_-]{12,}|sk_test_[A-Za-z0-9_-]{12,}|sk-proj-[A-Za-z0-9_-]{16,}|sk-ant-[A-Za-z0-9_-]{16,}|ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|gh[ousr]_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|https://hooks\.slack\.com/services/[A-Za-z0-9_-]+/[A-Za-z0-9_-]+/[A-Za-z0-9_-]+|https://discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+)\b"),
    ("sensitive-data.pii-pattern", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("sensitive-data.phi-pattern", rf"\b[1-9][{_MBI}][{_MBI}0-9]\d[{_MBI}][{_MBI}0-9]\d[{_MBI}][{_MBI}]\d\d\b"),
]
# Of these only the first match of a line counts, and its group is the value.
LABELLED = [
    ("sensitive-data.api-key-pattern", r"(?:^|:)_authToken\s*=\s*([A-Za-z0-9_-]{20,})\b"),
    ("sensitive-data.phi-pattern", r"(?i)\b(?:MRN|medical[\s_-]?record(?:[\s_-]?number)?)\b\s*[:=#]?\s*([0-9]{6,12})\b"),
]
_CARD = r"\b(?:\d[ -]?){12,18}\d\b"
_ENV = r"(?i)^\s*((?:API[_-]?KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|DATABASE_URL|DSN)|[A-Z][A-Z0-9_-]*(?:API[_-]?KEY|TOKEN|SECRET|PASSWORD|CREDENTIAL|DATABASE_URL|DSN)[A-Z0-9_-]*)\s*[:=]\s*[\"']?([^\"'\s#]+)[\"']?"
_NO_SECRET = r"(?i)^(?:x-api-key|token|secret|password|example|sample|placeholder)$"
_QUOTED = r"([\"'`])([A-Za-z0-9_+=./-]{24,})\1"
_FILE_NAME = r"\.(?:md|mdx|ts|tsx|js|jsx|mjs|cjs|json|yaml|yml|toml|html|css|svg|sh)$"
_FOLDER = r"(?:^|/)(?:src|test|tests|fixtures?|docs|scripts|bin|workflow|package(?:-lock)?\.json)(?:/|$)"
_NOTE_NAME = r"(?i)^(?:ADR-\d{3}|M\d{2,3})-[A-Za-z0-9_.-]+\.(?:md|mdx)$"


def secret_yields(config: Config = Config()) -> Column:
    """What the rules on secrets yield for one raw line, comments included: one finding per rule and value, with a redacted
    preview. Previews that are allowed drop out."""
    line = F.col("line")
    found = lambda rule_id, values: F.transform(values, lambda v: F.struct(F.lit(rule_id).alias("rule_id"), v.alias("value")))
    nothing = F.array().cast("array<string>")
    if_any = lambda value: F.when(value != "", F.array(value)).otherwise(nothing)
    parts = [found(rule_id, F.regexp_extract_all(line, F.lit(java(p)), F.lit(0))) for rule_id, p in SECRETS]
    parts += [found(rule_id, if_any(F.regexp_extract(line, java(p), 1))) for rule_id, p in LABELLED]
    digits = lambda v: F.regexp_replace(v, "[ -]", "")
    parts.append(found("sensitive-data.pii-pattern", F.filter(F.regexp_extract_all(line, F.lit(java(_CARD)), F.lit(0)), lambda v: F.coalesce(S.luhn(digits(v)) & S.card_issuer(digits(v)).isNotNull(), F.lit(False)))))
    value = F.regexp_extract(line, java(_ENV), 2)
    least = int(config.threshold("sensitive-data.hardcoded-env-value"))
    given = (F.length(value) >= least) & ~value.rlike(_NO_SECRET) & value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    parts.append(found("sensitive-data.hardcoded-env-value", F.when(given, F.array(value)).otherwise(nothing)))
    longest = int(config.threshold("sensitive-data.high-entropy-string"))

    def dense(v: Column) -> Column:
        distinct = F.size(F.array_distinct(F.split(v, "")))
        path = v.rlike(_FILE_NAME) & F.when(v.contains("/"), v.rlike(_FOLDER)).otherwise(v.rlike(_NOTE_NAME))
        shaped = (F.length(v) >= longest) & ~v.rlike("(?i)^[0-9a-f]+$") & ~v.rlike("^sha(?:256|384|512)-[A-Za-z0-9+/=]+$") & ~path
        return shaped & v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]") & (distinct >= F.least(F.lit(12), F.ceil(F.length(v) / 3))) & (S.entropy(v) >= 4.0)

    parts.append(found("sensitive-data.high-entropy-string", F.filter(F.regexp_extract_all(line, F.lit(_QUOTED), F.lit(2)), dense)))
    none = F.lit(None).cast("string")
    allowed, off = sorted(config.secret_previews), sorted(config.disabled)
    values = F.transform(F.concat(*parts), lambda v: F.struct(v["rule_id"].alias("rule_id"), S.redacted(v["value"]).alias("preview")))
    kept = F.filter(values, lambda v: ~v["preview"].isin(allowed) & ~v["rule_id"].isin(off)) if allowed or off else values
    message = "A value looks like a secret or a person's data: "
    return F.transform(kept, lambda v: F.struct(v["rule_id"].alias("rule_id"), F.col("n").cast("int").alias("line"), none.alias("symbol"), F.concat(F.lit(message), v["preview"]).alias("message"), none.alias("severity"), F.to_json(F.struct(v["preview"].alias("preview"))).alias("metadata_json")))


def secret_findings(lines: DataFrame, config: Config = Config()) -> DataFrame:
    """Secrets on raw lines. ``lines``: repo, file_path, n, line. Only built-in expressions are used."""
    return lines.where(F.col("line").isNotNull()).select("repo", "file_path", F.inline(secret_yields(config)))


_LOCK_FILES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb")


def length_yields(config: Config = Config()) -> Column:
    """What the rule on long files yields for a file, of its columns text and file_path; lock files are exempt."""
    lines = F.regexp_count("text", F.lit("\n")) + 1
    none = F.lit(None).cast("string")
    long = F.col("text").isNotNull() & ~S.base_name(F.col("file_path")).isin(*_LOCK_FILES) & (lines > config.threshold("size.file-length"))
    row = F.struct(F.lit("size.file-length").alias("rule_id"), F.lit(1).alias("line"), none.alias("symbol"), F.lit("The file is long.").alias("message"), none.alias("severity"), F.to_json(F.struct(lines.alias("lines"))).alias("metadata_json"))
    return F.when(F.coalesce(long, F.lit(False)), F.array(row)).otherwise(F.array().cast(YIELD))
