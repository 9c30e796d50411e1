"""Rules that need the state of a whole file: order of lines, offsets, scopes. Each is a generator over one lexed file.

They run in the Arrow batch that lexes the file anyway, so a file is read and scanned once. Words, lists and patterns that
stand in upper-case names are fixed values.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

from sievework.functions.lexing import Block, Comment, Lexed, is_commented, parameters
from sievework.functions.patterns import python
from sievework.operators.catalog import RULES, Config

_ID = r"[A-Za-z_$][A-Za-z0-9_$]*"
_ANY_CASE = re.I


@dataclass
class File:
    path: str
    text: str
    lexed: Lexed
    blocks: list[Block]
    comments: list[Comment]
    config: Config

    @cached_property
    def lines(self) -> list[str]:
        return re.split(r"\r?\n", self.text)

    @cached_property
    def code_lines(self) -> list[str]:
        return re.split(r"\r?\n", self.lexed.masked)

    @property
    def is_test(self) -> bool:
        return bool(re.search(r"(?:^|/)(?:__tests__|tests?|spec)/|\.(?:test|spec)\.[cm]?[tj]sx?$", self.path))

    @property
    def is_fixture(self) -> bool:
        return bool(re.search(r"(?:^|/)(?:__fixtures__|fixtures?|testdata)/", self.path))

    @cached_property
    def _ends(self) -> list[int]:
        return [c.end_line for c in self.comments]

    def above(self, line: int, gap: int = 1) -> Comment | None:
        """The last comment that ends above a line, if only blank lines stand between. The ``gap`` lines right above the
        line are not looked at: a decorator may stand there."""
        i = bisect_right(self._ends, line - 1) - 1
        if i < 0 or any(x.strip() for x in self.lines[self._ends[i] : line - 1 - gap]):
            return None
        return self.comments[i]

    def on(self, line: int) -> Comment | None:
        return next((c for c in self.comments if c.line <= line <= c.end_line), None)


@dataclass(frozen=True)
class Raw:
    rule_id: str
    line: int
    message: str
    symbol: str | None = None
    severity: str | None = None
    metadata: dict | None = None

    def row(self) -> dict:
        return {"rule_id": self.rule_id, "line": self.line, "message": self.message, "symbol": self.symbol, "severity": self.severity, "metadata_json": json.dumps(self.metadata) if self.metadata else None}


RULES_OF_FILES: list[Callable[[File], Iterator[Raw]]] = []


def rule(function: Callable[[File], Iterator[Raw]]) -> Callable[[File], Iterator[Raw]]:
    RULES_OF_FILES.append(function)
    return function


def file_findings(file: File) -> list[dict]:
    return [raw.row() for check in RULES_OF_FILES for raw in check(file) if file.config.enabled(raw.rule_id)]


# ---- dead code


def _occurs(name: str, code: str) -> int:
    return len(re.findall(rf"\b{re.escape(name)}\b", code, re.ASCII))


def _in_hole(name: str, text: str) -> bool:
    """Whether a name is used in a hole of a template, which the mask may have blanked."""
    return bool(re.search(rf"\$\{{[^}}]*\b{re.escape(name)}\b[^}}]*\}}", text, re.ASCII))


@rule
def unused_private_methods(f: File) -> Iterator[Raw]:
    for m in python(rf"\bprivate\s+({_ID})\s*\(").finditer(f.lexed.masked):
        if len(re.findall(re.escape(m.group(1)) + r"\s*\(", f.lexed.masked)) <= 1:
            yield Raw("dead-code.unused-private-method", f.lexed.line(m.start()), f"The private method {m.group(1)} is not called.", m.group(1))


@rule
def unreachable_code(f: File) -> Iterator[Raw]:
    """A line behind one that ends the flow. Labels reset that; what ends the flow within a condition without braces, whose
    parentheses may span lines, or in the line that depends on it, does so only at times."""
    ended, open_parens, depends = False, 0, False
    balance = lambda x: x.count("(") - x.count(")")
    for n, line in enumerate(f.code_lines, 1):
        text = line.strip()
        label = bool(python(r"(?:case\b.*:|default\s*:)$").match(text))
        ended = ended and not label
        if ended and text and not text.startswith("}"):
            yield Raw("waste.unreachable-code", n, "No path leads to this line.")
        guarded = open_parens > 0 or depends
        ended = bool(python(r"(?:return|throw|process\.exit)\b").match(text)) and text.endswith(";") and not guarded
        if text[-1:] not in ("{", "}") and python(r"(?:if|else\s+if|for|while)\s*\(|else\b|do\b").match(text):
            open_parens = max(balance(text), 0)
            depends = not open_parens
        elif open_parens:
            open_parens = max(open_parens + balance(text), 0)
            depends = not open_parens
        else:
            depends = False


@rule
def unused_imports(f: File) -> Iterator[Raw]:
    for m in python(r"\bimport\s+(?:type\s+)?\{([\s\S]*?)\}\s+from\s*[\"'][^\"']+[\"']").finditer(f.lexed.masked):
        for part in m.group(1).split(","):
            local = python(_ID).match(re.split(r"\s+as\s+", part.strip())[-1].strip())
            if local and _occurs(local.group(), f.lexed.masked) <= 1 and not _in_hole(local.group(), f.text):
                yield Raw("waste.unused-import", f.lexed.line(m.start()), f"The import {local.group()} is not used.", local.group(), metadata={"name": local.group()})


# ---- errors that are caught

_RATIONALE = r"\b(?:because|intentional|false positive|tracked in|M\d{1,3}|ADR-\d{3}|GH-\d+)\b|\breason\s*:|(?:^|\s)#\d+\b|https?://"
_CATCH_RATIONALE = (
    r"\b(?:already (?:closed|dead|gone)|optional|best effort|missing|unreadable|not a directory|doesn't exist|not available|non-fatal|cache write failure|composition continues|try next location|server unavailable|must not affect|explicit launch"
    r"|malformed messages|template missing|sets [A-Za-z_$][A-Za-z0-9_$]* = false|skip agents? that fail|ignored?|cleanup|teardown|noop|no-op)\b"
)


@rule
def catches(f: File) -> Iterator[Raw]:
    """Blocks that only throw the error again, and blocks that do nothing with it and say no reason."""
    code = f.lexed.masked
    for m in python(rf"\bcatch\s*\(\s*({_ID})\s*\)\s*\{{\s*throw\s+\1\s*;?\s*\}}").finditer(code):
        yield Raw("waste.useless-catch", f.lexed.line(m.start()), "A caught error is thrown again.", metadata={"binding": m.group(1)})
    for m in python(r"\bcatch\s*(?:\([^)]*\))?\s*\{([\s\S]*?)\}").finditer(code):
        said = f.text[m.start(1) : m.end(1)]
        reason = re.search(r"//|/\*", said) and (python(_RATIONALE, _ANY_CASE).search(said) or python(_CATCH_RATIONALE, _ANY_CASE).search(said))
        if not m.group(1).strip() and not reason:
            yield Raw("waste.swallowed-catch", f.lexed.line(m.start()), "An error is swallowed.")


# ---- classes and exported declarations


def _is_documented(f: File, line: int) -> bool:
    """Whether a documentation block ends above a line, with nothing but blank lines and decorators between."""
    above = next((x.strip() for x in reversed(f.lines[: line - 1]) if x.strip() and not x.strip().startswith("@")), "")
    return above.startswith(("/**", "*"))


def _plain(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]", "", name).lower()


@rule
def classes(f: File) -> Iterator[Raw]:
    code = f.lexed.masked
    for m in python(rf"\bpublic\s+{_ID}\s*[=:]").finditer(code):
        yield Raw("modernisation.public-property", f.lexed.line(m.start()), "A property is public.")
    for m in python(rf"\b(?:public|private|protected)\s+(?!readonly\b)({_ID})\s*:\s*[^;=\n]+;").finditer(code):
        yield Raw("modernisation.readonly-property-candidate", f.lexed.line(m.start()), f"The property {m.group(1)} could be readonly.", m.group(1))
    stem = re.sub(r"\.[^.]+$", "", f.path.rsplit("/", 1)[-1])
    for m in python(rf"\bexport\s+(class|type|enum)\s+({_ID})").finditer(code):
        kind, name, line = m.group(1), m.group(2), f.lexed.line(m.start())
        if not _is_documented(f, line):
            yield Raw("docs.missing-public-doc", line, f"The exported {kind} {name} has no documentation.", name)
        if kind == "class" and _plain(name) != _plain(stem):
            yield Raw("naming.class-file-mismatch", line, f"The class {name} stands in a file of another name.", name, metadata={"file": stem})


_INTERFACE = python(rf"^[ \t]*(?:export[ \t]+)?interface[ \t]+({_ID})\b", re.M)


def interfaces(f: File) -> list[tuple[str, int]]:
    return [(m.group(1), f.lexed.line(m.start())) for m in _INTERFACE.finditer(f.lexed.masked)]


@rule
def interface_docs(f: File) -> Iterator[Raw]:
    for name, line in interfaces(f):
        if not is_commented(f.lines, line - 1):
            yield Raw("docs.missing-interface-doc", line, f"The interface {name} has no comment.", name)


# ---- names

_STATES = frozenset("acknowledged exists validated detected resolved selected installed".split())
_STATE_ENDS = ("Available", "Required", "Validated", "Detected", "Resolved", "Selected", "Installed")
_NUMBERED_STEMS = frozenset("arg bar baz data fixture foo item mock obj object param stub temp test thing tmp value var".split())
_NEGATIONS = r"(?:disable|no|not|prevent|skip|disallow)[A-Z]"
_TYPE_BODY = python(rf"\b(?:export\s+)?(?:interface\s+{_ID}(?:\s*<[^>]*>)?(?:\s+extends\s+[^{{]+)?|type\s+{_ID}(?:\s*<[^>]*>)?\s*=\s*)\s*\{{")
_FIELD = python(rf"[ \t]*(?:readonly\s+)?({_ID})\??\s*:\s*([^;]*)")
_SHORT_BODY = 10


def fields(f: File) -> Iterator[tuple[str, int, str]]:
    """(name, line, type) of the fields of interfaces and object types, one line each."""
    for m in _TYPE_BODY.finditer(f.lexed.masked):
        first = f.lexed.line(m.end() - 1)
        if f.lexed.masked[m.end() : m.end() + 30].lstrip().startswith("["):
            continue
        tail = f.code_lines[first - 1].rpartition("{")[2]
        depth = 1 + tail.count("{") - tail.count("}")
        for n in range(first, len(f.code_lines)):
            if depth <= 0:
                break
            if depth == 1 and (g := _FIELD.match(f.lines[n])):
                yield g.group(1), n + 1, g.group(2)
            depth += f.code_lines[n].count("{") - f.code_lines[n].count("}")


def identifiers(f: File) -> list[tuple[str, int, str]]:
    """Declared names, parameters and fields: (name, line, surface), each once."""
    code = f.lexed.masked
    out = [(m.group(1), f.lexed.line(m.start()), "declaration") for m in python(rf"\b(?:export\s+)?(?:const|let|var)\s+({_ID})").finditer(code)]
    out += [(name, b.declaration_line, "parameter") for b in f.blocks for name, _ in parameters(b.params)]
    out += [(name, line, "interface-field") for name, line, _ in fields(f)]
    return list(dict.fromkeys(out))


def _loop_lines(code: list[str], first: int) -> float:
    """Lines of the braces that open from ``first`` on: 1 without braces, infinitely many if they stay open for long."""
    depth, opened = 0, None
    for n in range(first, min(len(code), first + 50)):
        if "{" in code[n] and opened is None:
            opened = n
        depth += code[n].count("{") - code[n].count("}")
        if opened is not None and depth <= 0:
            return n - opened + 1
    return 1 if opened is None else float("inf")


def _sorts(block: Block) -> bool:
    """Whether a function compares its parameters a and b."""
    ordered = r"\breturn\s+a\b[\s\S]*?(?:-\s*b\b|[<>]=?\s*b\b)|\breturn\s+b\b[\s\S]*?(?:-\s*a\b|[<>]=?\s*a\b)|\.localeCompare\s*\("
    return bool(re.match(r"compare[A-Z0-9_]?|.*Comparator$|by[A-Z]", block.name) or python(ordered).search(block.code_body))


def _local_names(f: File) -> Iterator[tuple[str, int, str, bool]]:
    """(name, line, surface, whether it may be short) of what is declared, taken as a parameter or taken apart."""
    declared = python(rf"\b(?:const|let|for\s*\(\s*const|for\s*\(\s*let)\s+({_ID})")
    apart = python(r"\b(?:const|let)\s+\{([^}]+)\}\s*=")
    for n, code in enumerate(f.code_lines, 1):
        for m in declared.finditer(code):
            loop = m.group().startswith("for") and python(r"\s+of\b").match(code, m.end())
            yield m.group(1), n, "declaration", bool(loop) and _loop_lines(f.code_lines, n - 1) <= _SHORT_BODY
        for m in apart.finditer(code):
            for part in m.group(1).split(","):
                name = python(r"\s*=[^,]*$").sub("", part.strip()).split(":")[-1].strip()
                if re.fullmatch(_ID, name):
                    yield name, n, "destructure", False
    for b in f.blocks:
        own = parameters(b.params)
        compared = [name for name, _ in own] == ["a", "b"] and _sorts(b)
        for name, _ in own:
            yield name, b.declaration_line, "parameter", compared


@rule
def quality_of_names(f: File) -> Iterator[Raw]:
    c = f.config
    for name, line, surface, may_be_short in _local_names(f):
        if not may_be_short and len(name) <= 2 and name not in ("i", "j", "k") and name.lower() not in c.accepted_abbreviations:
            yield Raw("naming.short-variable", line, f"The name {name} is very short.", name, metadata={"surface": surface})
        numbered = re.fullmatch(r"([A-Za-z_$]+)[0-9]+", name)
        stem = numbered.group(1).lower() if numbered else ""
        variant = "generic" if name.lower() in c.placeholder_names else "numbered" if stem and (stem in c.placeholder_names or stem in _NUMBERED_STEMS) else None
        if variant:
            yield Raw("naming.identifier-quality", line, f"The name {name} says nothing.", name, metadata={"variant": variant, "surface": surface})


def _booleans(f: File) -> Iterator[tuple[str, int, str]]:
    declared = python(rf"\b(?:const|let|var|public|private|protected)\s+({_ID})\??(?:\s*:\s*boolean|\s*=\s*(?:true|false)\b)")
    for n, code in enumerate(f.code_lines, 1):
        if m := declared.search(code):
            yield m.group(1), n, "declaration"
    for b in f.blocks:
        for name, raw in parameters(b.params):
            if python(r":\s*boolean\b").search(raw) or not python(r"\bas\b").search(raw) and python(r"=\s*(?:true|false)\s*$").search(raw):
                yield name, b.declaration_line, "parameter"
    for name, line, kind in fields(f):
        if python(r"\s*boolean\b").match(kind):
            yield name, line, "interface-field"


@rule
def names_of_booleans(f: File) -> Iterator[Raw]:
    c = f.config
    prefixed = re.compile("(?:" + "|".join(map(re.escape, sorted(c.boolean_prefixes))) + ")[A-Z_]") if c.boolean_prefixes else None
    for name, line, surface in _booleans(f):
        known = name.lower() in _STATES or name.endswith(_STATE_ENDS) or surface == "interface-field" and name.lower() in c.accepted_boolean_names
        if not (prefixed and prefixed.match(name)) and not known:
            yield Raw("naming.boolean-prefix", line, f"The name {name} of a boolean is no statement.", name, metadata={"surface": surface})
        if re.match(_NEGATIONS, name) and name.lower() not in c.negative_boolean_allowed:
            yield Raw("naming.negative-boolean", line, f"The name {name} of a boolean is negative.", name, metadata={"surface": surface})


@rule
def spelling_of_names(f: File) -> Iterator[Raw]:
    """One name in several spellings, and one acronym in capitals and otherwise. Both are told at the second occurrence."""
    known = identifiers(f)
    groups: dict[str, list[tuple[str, int, str]]] = defaultdict(list)
    for name, line, surface in known:
        groups[re.sub(r"[_-]", "", name.lower())].append((name, line, surface))
    constant = lambda name: bool(re.fullmatch(r"[A-Z][A-Z0-9_]*", name))
    for key, entries in groups.items():
        own = [e for e in entries if not e[0].startswith("_")]
        if any(s != "interface-field" and not constant(name) for name, _, s in own):
            own = [e for e in own if e[2] != "interface-field" and not constant(e[0])]
        spellings = sorted({name for name, _, _ in own})
        if key and len(spellings) >= 2:
            ordered = sorted(own, key=lambda e: e[1])
            first = ordered[0][0]
            second, line = next((name, line) for name, line, _ in ordered if name != first)
            yield Raw("naming.inconsistent-casing", line, f"The name {second} is also spelt {first}.", second, metadata={"variants": spellings})
    seen: dict[str, dict[str, tuple[int, str]]] = defaultdict(dict)
    for name, line, _ in known:
        if re.search(r"(?:^|[_-])fixture(?:[_-]|$)", name, re.I):
            continue
        for token in re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+", name):
            if token.lower() in f.config.known_acronyms:
                kind = "upper" if token == token.upper() else "lower" if token == token.lower() else "title"
                seen[token.lower()].setdefault(kind, (line, name))
    for acronym, kinds in seen.items():
        if "upper" in kinds and len(kinds) >= 2:
            line, name = sorted(kinds.values(), key=lambda k: k[0])[1]
            yield Raw("naming.acronym-case", line, f"The acronym {acronym.upper()} is written in several ways.", name, metadata={"variants": sorted(kinds)})


# ---- comments

_TRACKED = (r"(?i:https?://|\bGH-\d+\b|\bADR-\d{3}\b|\bowner\s*:)|(?:^|\s)#\d+\b|\bM\d{1,3}\b|\b\d{4}-\d{2}-\d{2}\b",)
_SUPPRESSION = r"\b(eslint-disable(?:-next-line|-line)?|biome-ignore|oxlint-disable|istanbul ignore|c8 ignore|v8 ignore|prettier-ignore)\b"
_USEFUL = r"\b(?:because|why|intentional|tradeoff|compat|avoid|preserve|invariant|contract|side effect|throws|writes|reads|persists|fallback|recover|stable|deterministic|schema|fingerprint)\b"
_HISTORY = r"\b(?:previously|legacy|compat|migration|ADR)\b"
_RULE_ID = r"\b((?:complexity|dead-code|design|docs|modernisation|naming|security|sensitive-data|size|test-quality|waste)\.[a-z0-9-]+)\b"
_FILLERS = frozenset("a an the this that function method helper type declaration".split())
_THRESHOLD_NAME = rf"{_ID}(?:Threshold|Limit|Cap|Budget|Timeout|Tolerance|Weight|Score|Max|Min|Default|Entropy|Length)[A-Za-z0-9_$]*"
_THRESHOLD_WORDS = r"\b(?:threshold|limit|cap|budget|tuned|default|because|empirical)\b"
_WHY_WORDS = r"\b(?:because|why|intentional|tradeoff|compat|avoid|preserve)\b"
_EFFECT_WORDS = r"\b(?:writes|reads|persists|mutates|starts|spawns|network|filesystem|environment)\b"
_ERROR_WORDS = r"\b(?:throws|returns diagnostic|reports|exits|swallows|fallback|recover)\b"
_CONTRACT_WORDS = r"\b(?:invariant|contract|must|stable|deterministic|schema|fingerprint)\b"
_EFFECTS = (
    r"\b(?:writeFile(?:Sync)?|appendFile(?:Sync)?|mkdir(?:Sync)?|rm(?:Sync)?|rename(?:Sync)?|createWriteStream)\s*\(|\bprocess\.chdir\s*\(|\bprocess\.env\.[A-Za-z0-9_]+\s*=|\b(?:exec|execFile|spawn)(?:Sync)?\s*\("
    r"|\b(?:response|res)\.(?:write|end|setHeader|writeHead)\s*\(|\bcreateServer\s*\(|\.listen\s*\("
)
_EFFECT_NAMES = r"(?:write|recordHistory|startDashboard)\b"
_ERRORS = r"\bthrow\b|\bcatch\b|\bprocess\.exit\s*\(|\bdiagnosticType\s*:|\b(?:findings|diagnostics)\.push\s*\("
_CONTRACTS = r"\b(?:fingerprint|schemaVersion|baseline|AnalysisReport|Finding|stable sort|deterministic|dedupe|sort)\b"
_INTERFACE_CONTRACTS = r"\b(?:fingerprint|schemaVersion|baseline|report|Finding|AnalysisReport|Baseline|stable|deterministic)\b"
#: Options of this engine's command line, for comments that speak of it.
OPTIONS = frozenset("--baseline --changed-ranges --changed-scope --config --diff --fail-on --force --format --help --history --include-ignored --json --profile --since --top --write-baseline".split())


def _split_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text).lower()) if w]


def _stem(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") else word


def _restates(text: str, name: str, kind: str) -> bool:
    """Whether a comment says no more than the name of what it documents, and at most one word besides."""
    if python(_USEFUL, _ANY_CASE).search(text):
        return False
    words = [_stem(w) for w in _split_words(re.sub(r"[^A-Za-z0-9_$]+", " ", text)) if w not in _FILLERS and w != kind]
    own = [_stem(w) for w in _split_words(name)]
    return not words or words[: len(own)] == own and len(words) <= len(own) + 1


def _declarations(f: File) -> list[tuple[str, str, int, bool, Block | None]]:
    """(kind, name, line, public, block) of callables that are no tests, and of interfaces."""
    return [*(("function", b.name, b.declaration_line, b.is_public, b) for b in f.blocks if not b.is_test), *(("interface", name, line, True, None) for name, line in interfaces(f))]


@rule
def single_comments(f: File) -> Iterator[Raw]:
    for c in f.comments:
        m = python(r"\b(TODO|FIXME|HACK|XXX)\b", _ANY_CASE).search(c.text)
        if m and not python(_TRACKED[0]).search(c.text):
            yield Raw("docs.todo-without-tracking", c.line, f"A {m.group(1).upper()} is tracked nowhere.", metadata={"marker": m.group(1).upper()})
        m = python(_SUPPRESSION, _ANY_CASE).search(c.text)
        if m and not python(r"@ts-(?:ignore|expect-error|nocheck|check)\b").search(c.text) and not python(_RATIONALE, _ANY_CASE).search(c.text):
            yield Raw("docs.suppression-without-rationale", c.line, f"{m.group(1)} stands without a reason.", metadata={"suppression": m.group(1)})
        if python(_HISTORY, _ANY_CASE).search(c.text):
            continue
        for m in python(_RULE_ID).finditer(c.text):
            if m.group(1) not in RULES:
                yield Raw("docs.stale-comment", c.line, f"The comment names the unknown rule {m.group(1)}.", metadata={"reference": m.group(1), "kind": "rule"})
        if python(r"\bsievework\b", _ANY_CASE).search(c.text):
            for m in re.finditer(r"(?<![A-Za-z0-9])--[a-z][a-z0-9-]*", c.text):
                if m.group() not in OPTIONS:
                    yield Raw("docs.stale-comment", c.line, f"The comment names the unknown option {m.group()}.", metadata={"reference": m.group(), "kind": "option"})


def _other_name(text: str, kind: str) -> str | None:
    """The name of another declaration that a comment begins with or speaks of; a plain word is none."""
    like_code = r"[A-Z].*[A-Z]|[a-z][A-Z]|[_$]|\d"
    for form in (rf"\b{kind}\s+(?:`({_ID})`|({_ID}))", rf"^(?:`({_ID})`|({_ID}))\s+(?:{kind}|helper|method|contract|type)\b"):
        for m in python(form, _ANY_CASE).finditer(text):
            if m.group(1) or re.search(like_code, m.group(2)):
                return m.group(1) or m.group(2)
            break
    return None


@rule
def commented_declarations(f: File) -> Iterator[Raw]:
    """What a comment above a declaration leaves out, repeats, or says of something else."""
    limits = f.config
    for kind, name, line, public, block in _declarations(f):
        c = f.above(line)
        if c is None:
            continue
        other = None if python(_HISTORY, _ANY_CASE).search(c.text) else _other_name(c.text, kind)
        if other and other != name:
            yield Raw("docs.stale-comment", c.line, f"The comment names {other} and documents {name}.", name, metadata={"reference": other, "kind": kind})
        restated = _restates(c.text, name, kind)
        if restated and not (kind == "function" and public and c.kind == "block"):
            yield Raw("docs.useless-docblock", c.line, f"The comment of {name} repeats the name.", name)
        if kind == "interface" and not restated and not python(_CONTRACT_WORDS, _ANY_CASE).search(c.text):
            last = next((i for i in range(line - 1, len(f.lines)) if f.lines[i].strip() == "}"), len(f.lines) - 1)
            if python(_INTERFACE_CONTRACTS, _ANY_CASE).search("\n".join([name, *f.lines[line - 1 : last + 1]])):
                yield Raw("docs.missing-invariant-doc", c.line, f"The comment leaves out the contract of {name}.", name)
    for b in f.blocks:
        c = f.above(b.declaration_line)
        if c is None or _restates(c.text, b.name, "function"):
            continue
        silent = lambda words: not python(words, _ANY_CASE).search(c.text)  # noqa: B023, E731
        paths = len(python(r"\b(?:if|switch|case|for|while|catch)\b|\?|&&|\|\|").findall(b.code_body)) + 1
        deep = nesting(b.code_body)
        hard = b.line_count > limits.threshold("size.function-length") or paths > limits.threshold("complexity.cyclomatic") or paths + deep > limits.threshold("complexity.cognitive") or deep > 3
        if hard and silent(_WHY_WORDS):
            yield Raw("docs.missing-why-for-complex-code", c.line, f"The comment gives no reason for the shape of {b.name}.", b.name)
        if (python(_EFFECTS).search(b.code_body) or python(_EFFECT_NAMES).match(b.name)) and silent(_EFFECT_WORDS):
            yield Raw("docs.missing-side-effect-doc", c.line, f"The comment leaves out what {b.name} changes outside.", b.name)
        if python(_ERRORS).search(b.code_body) and silent(_ERROR_WORDS):
            yield Raw("docs.missing-error-behavior-doc", c.line, f"The comment leaves out how {b.name} fails.", b.name)
        if python(_CONTRACTS, _ANY_CASE).search(f"{b.name}\n{b.code_body}") and silent(_CONTRACT_WORDS):
            yield Raw("docs.missing-invariant-doc", c.line, f"The comment leaves out the contract of {b.name}.", b.name)


def nesting(code: str) -> int:
    """Deepest brace less one; a brace that closes nothing counts for nothing."""
    depth = deepest = 0
    for mark in re.findall(r"[{}]", code):
        depth = max(depth + (1 if mark == "{" else -1), 0)
        deepest = max(deepest, depth)
    return max(deepest - 1, 0)


@rule
def thresholds(f: File) -> Iterator[Raw]:
    if f.is_test:
        return
    named = python(rf"\b(?:const|let|var)\s+({_THRESHOLD_NAME})\b[^=\n]*=\s*(-?\d+(?:\.\d+)?)", _ANY_CASE)
    given = python(r"\bthreshold\s*\([^)]*,\s*[\"']([^\"']+)[\"']\s*,\s*[\"']([^\"']+)[\"']\s*,\s*(-?\d+(?:\.\d+)?)\s*\)")
    for n, (line, code) in enumerate(zip(f.lines, f.code_lines), 1):
        label = value = None
        if python(rf"\b(?:const|let|var)\s+{_THRESHOLD_NAME}\b", _ANY_CASE).search(code) and (m := named.search(line)):
            label, value = m.groups()
        if (value is None or value in ("-1", "0", "1", "2")) and python(r"\bthreshold\s*\(").search(code) and (m := given.search(line)):
            label, value = f"{m.group(1)}.{m.group(2)}", m.group(3)
        if label is None or value in ("-1", "0", "1", "2"):
            continue
        near = [c.text for c in (f.on(n), f.above(n)) if c]
        if not any(python(_THRESHOLD_WORDS, _ANY_CASE).search(t) for t in near):
            yield Raw("docs.magic-threshold-without-rationale", n, f"The limit {label} is set without a reason.", label, metadata={"value": value})


@rule
def overview(f: File) -> Iterator[Raw]:
    shown = [i for i, x in enumerate(f.lines) if x.lstrip("﻿").strip()]
    if shown and f.lines[shown[0]].lstrip("﻿").startswith("#!"):
        shown = shown[1:]
    plain = [f.lines[0].lstrip("﻿"), *f.lines[1:]]
    if not shown or not is_commented(plain[: shown[0] + 1] + plain[shown[0] + 1 :], shown[0] + 1):
        yield Raw("docs.missing-file-overview", 1, "The file says nowhere what it is for.")


@rule
def documented_exports(f: File) -> Iterator[Raw]:
    """Tags and words of documentation blocks right above exported functions, told at the block's first line."""
    for m in python(rf"/\*\*((?:(?!\*/)[\s\S])*?)\*/\s*(export)\s+function\s+({_ID})\s*\(([^)]*)\)\s*(?::\s*([^{{\n]+))?").finditer(f.text):
        if f.lexed.masked[m.start(2)] != "e":
            continue
        doc, name, own, returns, line = m.group(1), m.group(3), [p for p, _ in parameters(m.group(4))], (m.group(5) or "").strip(), f.lexed.line(m.start())
        tags = [t.group(1) for x in re.split(r"\r?\n", doc) if (t := python(rf"@param\s*(?:\{{[^}}]*\}}\s*)?({_ID})").search(x))]
        for t in tags:
            if t not in own:
                yield Raw("docs.stale-param-tag", line, f"The described parameter {t} of {name} does not exist.", name, metadata={"parameter": t})
        for p in own:
            if p not in tags:
                yield Raw("docs.missing-param-tag", line, f"The parameter {p} of {name} is not described.", name, metadata={"parameter": p})
        if returns and not re.match(r"void\b", returns) and not python(r"@returns?\b").search(doc):
            yield Raw("docs.missing-return-tag", line, f"The result of {name} is not described.", name)
        said = [x for raw in re.split(r"\r?\n", doc) if (x := re.sub(r"^\s*\*\s?", "", raw).strip()) and not x.startswith("@")]
        words = re.sub(r"[^a-z0-9]+", " ", " ".join(said).lower()).split()
        if not words or words == _split_words(name) or "".join(words) == _plain(name):
            yield Raw("docs.useless-docblock", line, f"The documentation of {name} repeats the name.", name)


# ---- fixtures

_PURPOSE = r"\b(?:fixture|covers|reproduces|regression|scanner|parse|baseline|fingerprint|noise|valid case|invalid case|because|M\d{1,3})\b"
_FIXTURE_CALLS = ("analyseFixture", "analyseProject", "writeFileSync")
_FIXTURE_NAME = rf"\b(?:const|let|var)\s+({_ID}(?:Fixture|FIXTURE)[A-Za-z0-9_$]*)\b[^=\n]*="
_SOURCE_WORDS = r"\b(?:function|class|interface|type|enum|const|let|var|import|export|test|it)\b"
_ASSERTION = r"\bassert(?:\.[A-Za-z]+|[A-Z][A-Za-z0-9_$]*)?\s*\(|\bexpect(?:\.(?:assertions|hasAssertions)|[A-Z][A-Za-z0-9_$]*)?\s*\(|\b[A-Za-z_$][A-Za-z0-9_$]*Check\s*\(|\.(?:rejects|resolves)\b|\b(?:doesNotReject|rejects)\s*\("
_LONG_FIXTURE = 12


def setup_lines(code: str) -> int:
    """Lines of a test's body before its first assertion, without blank ones and closing braces."""
    low, high = code.find("{"), code.rfind("}")
    body = code[low + 1 : high] if 0 <= low < high else code.partition("=>")[2]
    count = 0
    for line in re.split(r"\r?\n", body):
        if line.strip() in ("", "}", "});"):
            continue
        if python(_ASSERTION).search(line):
            break
        count += 1
    return count


@rule
def fixtures(f: File) -> Iterator[Raw]:
    """Long fixtures in tests: quoted sources, generated ones, and long setups in tests that hold none of these."""
    if not (f.is_test or f.is_fixture):
        return
    found: dict[tuple[int, str, str], int] = {}
    for n, (line, code) in enumerate(zip(f.lines, f.code_lines), 1):
        named = python(_FIXTURE_NAME).search(code) or python(r"\b(?:const|let|var)\b").search(code) and python(_FIXTURE_NAME).search(line)
        called = next((c for c in _FIXTURE_CALLS if python(rf"\b{c}\s*\(").search(code)), None)
        at = f.lexed.line_starts[n - 1]
        tick = f.text.find("`", at, at + len(line))
        if tick >= 0 and (called or python(_FIXTURE_NAME).search(code)):
            body = re.compile(r"((?:[^`\\]|\\[\s\S])*)`").match(f.text, tick + 1)
            long = body and body.group(1).count("\n") + 1
            if long and long > _LONG_FIXTURE and python(_SOURCE_WORDS).search(body.group(1)):
                found.setdefault((n, called or named.group(1), "source"), long)
        made = python(r"\bArray\.from\s*\(\s*\{\s*length\s*:\s*(\d+)").search(code)
        if made and named and int(made.group(1)) > _LONG_FIXTURE:
            found.setdefault((n, named.group(1), "generated"), int(made.group(1)))
    taken = sorted({n for n, _, _ in found})
    for b in f.blocks:
        occupied = bisect_right(taken, b.start_line + b.line_count - 1) > bisect_right(taken, b.start_line - 1)
        if b.is_test and not occupied and (python(r"\b(?:analyseFixture|writeFileSync|mkdtempSync|Array\.from)\s*\(").search(b.code_body) or re.search(r"fixture", b.code_body, re.I)):
            count = setup_lines(b.code_body)
            if count > f.config.threshold("test-quality.setup-bloat"):
                found.setdefault((b.declaration_line, b.name, "setup"), count)
    for (n, symbol, kind), size in found.items():
        near = [c.text for c in (f.on(n), f.above(n, gap=0)) if c]
        if not any(python(_PURPOSE, _ANY_CASE).search(t) for t in near):
            yield Raw("docs.fixture-purpose-missing", n, f"The long fixture {symbol} has no purpose.", symbol, metadata={"kind": kind, "lines": size})


# ---- control flow in tests

_FIXTURE_LIST = r"(?:agents|cases|checks|entries|examples|fixtures|files|ids|paths|records|scenarios|scores|snapshots)$"
_FIXTURE_CALL = r"\b(?:glob|globSync|readdir|readdirSync|discover[A-Za-z0-9_$]*|find[A-Za-z0-9_$]*|list[A-Za-z0-9_$]*)\s*\("
_CLOSING_ASSERTION = r"(?:assert\.[a-z]+\s*\(|expect\s*\(|[a-z][A-Za-z0-9_]*\.should(?:Be|Equal)?\s*\()"


def _governed(code: str, at: int) -> str:
    """What the control word at ``at`` governs: to the closing brace, or the rest of the line without one."""
    line_end, brace = code.find("\n", at), code.find("{", at)
    line_end = len(code) if line_end < 0 else line_end
    if brace < 0 or brace > line_end:
        return code[at:line_end]
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, brace):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return code[at : m.end()]
    return code[at : brace + 1]


def _membership(before: str, governed: str) -> bool:
    """Whether a condition asks for membership in a constant list or set that is declared in front of it."""
    m = python(rf"\b({_ID})\.(?:has|includes)\s*\(").search(governed[: max(governed.find("{"), 0)])
    return bool(m and python(rf"\bconst\s+{re.escape(m.group(1))}\s*=\s*(?:new\s+Set\s*\(|\[)").search(before))


def _sweeps(code: str, at: int, loop: str) -> bool:
    """Whether a loop goes over a table of cases and ends with an assertion, whatever the case."""
    head, brace, body = loop.partition("{")
    listed = python(r"\bof\s*\[|\bof\s+Object\.(?:entries|keys|values)\s*\(").search(head)
    m = python(rf"\bof\s+({_ID})\b").search(head)
    if not listed and m and re.search(_FIXTURE_LIST, m.group(1), re.I):
        made = python(rf"\bconst\s+{re.escape(m.group(1))}\s*=\s*([\s\S]*?);\s*\Z").search(code[:at])
        value = made.group(1).strip() if made else ""
        listed = re.fullmatch(r"[A-Z0-9_]+", m.group(1)) or python(r"\[|Object\.(?:entries|keys|values)\s*\(").match(value) or python(_FIXTURE_CALL).search(value)
    if not listed or not brace:
        return False
    body = body[:-1]
    if python(r"\bswitch\s*\(|\bcase\s|\bdefault\s*:").search(body):
        return False
    for branch in python(r"\bif\b").finditer(body):
        inner = _governed(body, branch.start())
        if python(_ASSERTION).search(inner) and not _membership(code[: at + len(head) + 1] + body[: branch.start()], inner):
            return False
    steps = [x.strip() for x in re.split(r"[;\n]", body) if x.strip() not in ("", "}") and not python(r"(?:break|continue)\b").match(x.strip())]
    return bool(steps) and bool(python(_CLOSING_ASSERTION, _ANY_CASE).match(steps[-1]))


@rule
def control_flow_in_tests(f: File) -> Iterator[Raw]:
    for b in f.blocks:
        if not b.is_test:
            continue
        code = b.code_body
        parts = lambda words: ((m.start(), _governed(code, m.start())) for m in python(words).finditer(code))  # noqa: B023, E731
        if any(python(_ASSERTION).search(part) and not _sweeps(code, at, part) for at, part in parts(r"\b(?:for|while)\b")):
            yield Raw("test-quality.loop-in-test", b.start_line, "An assertion runs in a loop.", b.name)
        if any(python(_ASSERTION).search(part) and not _membership(code[:at], part) for at, part in parts(r"\b(?:if|switch)\b")):
            yield Raw("test-quality.conditional-logic", b.start_line, "An assertion depends on a condition.", b.name)


# ---- processes

_FIXED_ARGV = r"\s*(?:[\"'][^\"']+[\"']|process\.execPath)\s*(?:,\s*(?:\[|[A-Za-z_$][A-Za-z0-9_$]*)|$)"
_VERSION_PROBE = rf"\s*{_ID}(?:\.{_ID})*\.terminalBinary\s*,\s*\[\s*[\"']--version[\"']\s*\]"
_TEST_COMMANDS = r"\s*(?:\"node scripts/[^\"]+\"|'node scripts/[^']+'|`(?:bash -n|wc -l\b)[^`]*`)"


def closing(code: str, at: int) -> int | None:
    """The offset of the parenthesis that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[()]").finditer(code, at):
        depth += 1 if m.group() == "(" else -1
        if not depth:
            return m.start()
    return None


@rule
def processes(f: File) -> Iterator[Raw]:
    code = f.lexed.masked
    for m in python(r"\b(?:(child_process|childProcess|cp)\.)?(exec|spawn|execFile|execSync|execFileSync|spawnSync|fork)\s*\(").finditer(code):
        name, end = m.group(2), closing(code, m.end() - 1)
        if end is None or not m.group(1) and code[m.start() - 1 : m.start()] == ".":
            continue
        args, segment = f.text[m.end() : end], code[m.start() : end + 1]
        shell = python(r"\bshell\s*:\s*true\b").search(segment)
        if not shell and name in ("spawn", "spawnSync", "execFile", "execFileSync"):
            if python(_FIXED_ARGV).match(args) or python(_VERSION_PROBE).match(args) or _constant_command(f.text[: m.start()], args):
                continue
            if re.search(r"(?:^|/)safe-exec\.ts$", f.path) and name.startswith("spawn") and python(r"\bshell\s*:\s*false\b").search(segment):
                continue
        if not shell and f.is_test and (python(r"\s*process\.execPath\s*,\s*\[").match(args) or name in ("exec", "execSync") and python(_TEST_COMMANDS).match(args)):
            continue
        yield Raw("security.process-exec", f.lexed.line(m.start()), "A process is started; its arguments have to be checked.")


def _constant_command(before: str, args: str) -> bool:
    """Whether the command is a constant of plain strings declared by the statement in front of the call."""
    m = python(rf"\s*({_ID})\s*,\s*(?:\[|[A-Za-z_$])").match(args)
    made = m and re.search(rf"\bconst\s+{re.escape(m.group(1))}\s*=\s*([^;]+);\s*\Z", before)
    return bool(made and re.search(r"[\"'][^\"']+[\"']", made.group(1)) and not re.search(r"[`$()\[\]{}]", made.group(1)))


# ---- flows of outside data

_SOURCES = (
    ("request", r"\b(?:req|request|ctx)\.(?:query|params|body|headers|cookies)\b"),
    ("cli-argument", r"\bprocess\.argv(?:\s*\[|\b)"),
    ("environment", r"\bprocess\.env\.[A-Za-z_$][A-Za-z0-9_$]*"),
    ("browser-location", r"\blocation\.search\b|\bURLSearchParams\s*\(\s*location\.search\b"),
)
_LINE_SINKS = (
    ("security.path-traversal-candidate", r"\b(?:fs\.)?(?:readFile|readFileSync|writeFile|writeFileSync|appendFile|appendFileSync|createReadStream|createWriteStream|stat|statSync|readdir|readdirSync|unlink|unlinkSync|rm|rmSync|mkdir|mkdirSync)\s*\("),
    ("security.ssrf-candidate", r"\b(?:fetch|axios\.(?:get|post|put|patch|delete|request)|(?:http|https)\.(?:request|get))\s*\("),
    ("security.open-redirect-candidate", r"\b(?:(?:res|reply|response)\.redirect|redirect|(?:location|window\.location)\.(?:assign|replace))\s*\(|\b(?:location|window\.location)\.href\s*="),
    ("security.dynamic-regexp", r"\b(?:new\s+RegExp|RegExp)\s*\("),
)
# Names of calls that do harm with outside data, and whether one line may hold both ends.
_CALL_SINKS = (
    ("security.path-traversal-candidate", r"(?:.*\.)?(?:readFile|readFileSync|writeFile|writeFileSync|appendFile|appendFileSync|createReadStream|createWriteStream|stat|statSync|readdir|readdirSync|unlink|unlinkSync|rm|rmSync|mkdir|mkdirSync)", False),
    ("security.ssrf-candidate", r"(?:.*\.)?fetch|axios\.(?:get|post|put|patch|delete|request)|https?\.(?:request|get)", False),
    ("security.open-redirect-candidate", r"(?:res|reply|response)\.redirect|redirect|(?:location|window\.location)\.(?:assign|replace)", False),
    ("security.dynamic-regexp", r"RegExp", False),
    ("security.unsafe-deserialization", r"eval|Function|(?:.*\.)?unserialize|(?:yaml|YAML|jsYaml|jsyaml)\.load|vm\.(?:runInNewContext|runInThisContext|runInContext)|(?:vm\.)?Script", True),
    ("security.xxe-candidate", r"(?:libxmljs\.)?(?:parseXml|parseXmlString)", True),
)
_SAFE_SCHEMA = r"\bschema\s*:\s*(?:[A-Za-z_$][A-Za-z0-9_$]*\.)?(?:FAILSAFE_SCHEMA|JSON_SCHEMA|CORE_SCHEMA)\b"
_XML_OPTIONS = r"\b(?:noent|dtdload|processEntities)\s*:\s*true\b|\bresolveEntity\s*:"
_XML_PARSERS = r"new\s+(?:(?:fastXmlParser\.)?XMLParser\s*\([^)]*\bprocessEntities\s*:\s*true|(?:xmldom\.)?DOMParser\s*\([^)]*\bresolveEntity\s*:)"
_SANITISERS = r"\b(?:escapeRegExp|escapeStringRegexp|regexpEscape|RegExp\.escape)\s*\("
_FUNCTION_HEAD = python(r"(?:=>|\bfunction\b[^(){}]*\([^{}]*\)\s*(?::[^{}=;]+)?|^[ \t]*(?:(?:public|private|protected|static|async|override|get|set)\s+)*(?!(?:if|for|while|switch|catch|with)\b)[#A-Za-z_$][A-Za-z0-9_$]*\s*\([^{}]*\)\s*(?::[^{}=;]+)?)\s*\Z", re.M)
_LINE_CALL = 240
_FURTHEST_ALIAS = 2


@dataclass(frozen=True)
class Taint:
    line: int
    kind: str
    depth: int


class _Flow:
    """Outside data in one file: which names of a function hold it, and which calls get it. A function's names count in
    it alone, so what a nested function captures is not followed."""

    def __init__(self, f: File):
        self.f, self.code = f, f.lexed.masked
        self.scopes = self._functions()
        self.starts = [s for s, _ in self.scopes]
        self.held: dict[int, dict[str, Taint]] = defaultdict(dict)
        self.parsers: dict[int, set[str]] = defaultdict(set)

    def _functions(self) -> list[tuple[int, int]]:
        """Offsets of the bodies of functions, by their braces, or by the end of the expression of an arrow."""
        out, opened = [], []
        for m in re.finditer(r"[{}]", self.code):
            if m.group() == "{":
                head = max(self.code.rfind(c, 0, m.start()) for c in ";{}") + 1
                opened.append((m.start(), bool(_FUNCTION_HEAD.search(self.code[head : m.start()]))))
            elif opened:
                start, is_function = opened.pop()
                if is_function:
                    out.append((start, m.end()))
        for m in re.finditer(r"=>\s*(?![\s{])", self.code):
            out.append((m.end(), self.expression(m.end())))
        return sorted(out)

    def scope(self, at: int) -> int:
        """The innermost function around an offset, -1 for none."""
        i = bisect_right(self.starts, at) - 1
        while i >= 0 and self.scopes[i][1] <= at:
            i -= 1
        return i

    def expression(self, at: int) -> int:
        """The end of the expression at ``at``: a comma, semicolon or closing bracket of its own level, or a line's end that
        the next line does not go on from."""
        depth = 0
        for m in re.compile(r"[()\[\]{},;]|\n\s*(?![\s.?:+\-*/&|=<>,)\]}])").finditer(self.code, at):
            mark = m.group()
            if mark in ("(", "[", "{"):
                depth += 1
            elif mark in (")", "]", "}"):
                depth -= 1
                if depth < 0:
                    return m.start()
            elif not depth and not (mark[0] == "\n" and re.search(r"[=(,+\-*/&|?:]\s*\Z", self.code[at : m.start()])):
                return m.start()
        return len(self.code)

    def cleaned(self, low: int, high: int) -> str:
        """Code without calls that make data harmless and without nested functions; lengths are kept."""
        part = self.code[low:high]
        for m in python(_SANITISERS).finditer(self.code, low, high):
            end = closing(self.code, m.end() - 1)
            part = _blanked(part, m.start() - low, (high if end is None else end + 1) - low)
        for start, end in self.scopes[bisect_right(self.starts, low - 1) : bisect_right(self.starts, high - 1)]:
            part = _blanked(part, start - low, min(end, high) - low)
        return part

    def reached(self, low: int, high: int, names: dict[str, Taint]) -> Taint | None:
        """The first outside data in a piece of code: by a name that holds some, or by itself."""
        part = self.cleaned(low, high)
        first: tuple[int, Taint] | None = None
        for kind, p in _SOURCES:
            if (m := python(p).search(part)) and (first is None or m.start() < first[0]):
                first = (m.start(), Taint(self.f.lexed.line(low + m.start()), kind, 0))
        for m in re.finditer(rf"(?<![\w$.])({_ID})(?![\w$])", part):
            if first is not None and m.start() >= first[0]:
                break
            if m.group(1) in names:
                return names[m.group(1)]
        return first[1] if first else None

    def bound(self, low: int, high: int, names: dict[str, Taint]) -> Taint | None:
        """What a name holds that gets the value of an expression: outside data, or that of another name."""
        bare = self.code[low:high].strip()
        if re.fullmatch(_ID, bare):
            before = names.get(bare)
            return Taint(before.line, before.kind, before.depth + 1) if before and before.depth < _FURTHEST_ALIAS else None
        part = self.cleaned(low, high)
        kind = next((k for k, p in _SOURCES if python(p).search(part)), None)
        return Taint(self.f.lexed.line(low + len(self.code[low:high]) - len(self.code[low:high].lstrip())), kind, 1) if kind else None

    def run(self) -> Iterator[Raw]:
        events = python(
            rf"\b(?P<declared>const|let|var)\s+(?P<left>{_ID}|\{{[^}}]*\}}|\[[^\]]*\])\s*(?::[^=;]+?)?=(?![=>])|(?<![\w$.])(?P<assigned>{_ID}(?:\.{_ID})*)\s*=(?![=>])|(?P<callee>(?:new\s+)?(?<![\w$]){_ID}(?:\s*\??\.\s*{_ID})*)\s*\("
        )
        at = 0
        while m := events.search(self.code, at):
            here, at = self.scope(m.start()), m.end()
            names = self.held[here]
            if m.group("left"):
                end = self.expression(m.end())
                taint = self.bound(m.end(), end, names)
                if taint:
                    names.update((n, taint) for n in _bound_names(m.group("left")))
                if python(_XML_PARSERS).match(self.code[m.end() : end].strip()):
                    self.parsers[here].add(m.group("left"))
            elif m.group("assigned"):
                left, end = m.group("assigned"), self.expression(m.end())
                if re.fullmatch(r"(?:window\.)?location\.href", left):
                    hit, line = self.reached(m.end(), end, names), self.f.lexed.line(m.start())
                    if hit and hit.line != line:
                        yield self.found("security.open-redirect-candidate", line, hit)
                elif "." not in left:
                    taint = self.bound(m.end(), end, names)
                    names.pop(left, None)
                    if taint:
                        names[left] = taint
            else:
                yield from self.call(re.sub(r"^new\s+|[\s?]", "", m.group("callee")), m.start(), m.end() - 1, names, self.parsers[here])

    def call(self, callee: str, start: int, opened: int, names: dict[str, Taint], parsers: set[str]) -> Iterator[Raw]:
        rule_id, same_line = next(((r, s) for r, p, s in _CALL_SINKS if re.fullmatch(p, callee)), (None, False))
        end = closing(self.code, opened)
        if end is None:
            return
        args = self.code[opened + 1 : end]
        if rule_id == "security.unsafe-deserialization" and callee.endswith(".load") and python(_SAFE_SCHEMA).search(args):
            return
        if rule_id == "security.xxe-candidate" and not python(_XML_OPTIONS).search(args):
            return
        if rule_id is None and re.fullmatch(rf"({_ID})\.(?:parse|parseFromString)", callee) and callee.split(".")[0] in parsers:
            rule_id, same_line = "security.xxe-candidate", True
        if rule_id is None and python(_XML_PARSERS).match(self.code[start : end + 1]):
            # a parser that is made and used at once: what its method gets counts
            method = python(r"\s*\.\s*(?:parse|parseFromString)\s*\(").match(self.code, end + 1)
            if method:
                opened, end, rule_id, same_line = method.end() - 1, closing(self.code, method.end() - 1), "security.xxe-candidate", True
        if rule_id is None or end is None:
            return
        hit, line = self.reached(opened + 1, end, names), self.f.lexed.line(start)
        if hit and (same_line or hit.line != line):
            yield self.found(rule_id, line, hit)

    def found(self, rule_id: str, line: int, hit: Taint) -> Raw:
        return Raw(rule_id, line, "Outside data reaches a sensitive call.", metadata={"source": hit.kind, "depth": hit.depth})


def _blanked(text: str, low: int, high: int) -> str:
    return text[:low] + " " * (high - low) + text[high:]


def _bound_names(left: str) -> list[str]:
    if left[0] not in "{[":
        return [left]
    parts = (re.split(r"=", p)[0].split(":")[-1].strip().lstrip(".") for p in left[1:-1].split(","))
    return [p for p in parts if re.fullmatch(_ID, p)]


@rule
def flows(f: File) -> Iterator[Raw]:
    """Outside data that reaches a sensitive call: within one line, or by a name of the same function, over two names at
    most. A name that is given harmless data is harmless from there on."""
    if not any(python(p).search(f.lexed.masked) for _, p in _SOURCES):
        return
    for n, code in enumerate(f.code_lines, 1):
        kind, source = next(((k, p) for k, p in _SOURCES if python(p).search(code)), (None, ""))
        if kind is None:
            continue
        for rule_id, sink in _LINE_SINKS:
            for m in python(sink).finditer(code):
                # the call as far as its first closing parenthesis; 240 characters are a fixed value
                if python(source).search(code[m.start() : m.start() + _LINE_CALL].partition(")")[0]):
                    yield Raw(rule_id, n, "Outside data reaches a sensitive call.", metadata={"source": kind})
                    break
    yield from _Flow(f).run()
