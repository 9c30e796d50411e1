"""Problem 1: functions paired with their documentation, by an island grammar.

Only documentation, decorators, signatures and balanced bodies are parsed; everything else is water that is skipped
token by token. An island is a named function declaration, a function or arrow function with a braced body that is
assigned to a const, or a class method with a body.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.files import per_file
from sievework.llm.script_parser import DIALECTS, ParseError, Parser, deep_enough, script_errors
from sievework.llm.syntax import language
from sievework.shared import table

NAME, STRING, NUMBER, PUNCT, TEMPLATE, REGEX = 3, 4, 5, 6, 7, 8
_ID = r"#?[A-Za-z_$ª-\U0010ffff][\w$]*"
_TOKEN = re.compile(
    rf"[\s﻿]*(?:(//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|({_ID})|(\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|(\d[\w.]*)|(=>|\.\.\.|\?\.|[\s\S]))"
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\\\]\n]|\\.)*\])+/[A-Za-z]*")
_BEFORE_REGEX = frozenset("return typeof case in of do else void delete throw new instanceof yield await".split())
_EXPRESSION_BEFORE = frozenset("return typeof case in of void delete throw new instanceof yield await extends".split())
_MODIFIERS = frozenset("public private protected readonly static abstract override declare async get set accessor".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


@dataclass(slots=True)
class Token:
    kind: int
    value: str
    start: int
    end: int
    partner: int = -1


@dataclass(frozen=True)
class Island:
    """A function: its name, where the name stands, its text from the first decorator or modifier on, parameter names,
    and the comments directly above, joined by line feeds."""

    name: str
    name_at: int
    start: int
    end: int
    params: tuple[str, ...]
    comment: str


class Scanner:
    """Tokens of a script with matched brackets, and its comments apart."""

    def __init__(self, text: str):
        self.text = text
        self.tokens: list[Token] = []
        self.comments: list[tuple[int, int]] = []
        self._scan(1 if text.startswith("﻿") else 0)

    def _scan(self, at: int) -> None:
        text, tokens, comments = self.text, self.tokens, self.comments
        opened: list[int] = []
        templates: list[int] = []  # depth of brackets at which a template's hole began
        if text.startswith("#!", at):
            at = text.find("\n", at) if "\n" in text else len(text)
        size, match = len(text), _TOKEN.match
        while at < size:
            m = match(text, at)
            if not m:
                break
            kind = m.lastindex + 1  # the groups are in the order of the kinds, and comments come first
            at, end = m.start(kind - 1), m.end()
            if kind == NAME:
                tokens.append(Token(NAME, text[at:end], at, end))
                at = end
                continue
            if kind == 2:
                comments.append((at, end))
                at = end
                continue
            if kind == STRING and text[at] == "'" and at and (text[at - 1].isalnum() or text[at - 1] == "_") and not (tokens and tokens[-1].kind == NAME and tokens[-1].value in _BEFORE_REGEX):
                at += 1  # an apostrophe in the text of an element
                continue
            if kind == PUNCT:
                value = text[at:end]
                if value.isspace():
                    break  # nothing but blanks is left
                if value == "/":
                    before = tokens[-1] if tokens else None
                    if before is None or before.kind == PUNCT and before.value not in ")]}" or before.kind == NAME and before.value in _BEFORE_REGEX:
                        r = _REGEX.match(text, at)
                        if r:
                            tokens.append(Token(REGEX, "/", at, r.end()))
                            at = r.end()
                            continue
                elif value == "`" or value == "}" and templates and templates[-1] == len(opened):
                    if value == "}":
                        templates.pop()
                    end = _TEMPLATE.match(text, end).end()
                    hole = text.startswith("${", end)
                    end = min(end + (2 if hole else 1), size)  # a template may be cut off by the end of the text
                    tokens.append(Token(TEMPLATE, "`", at, end))
                    if hole:
                        templates.append(len(opened))
                    at = end
                    continue
                elif value in _OPEN:
                    opened.append(len(tokens))
                elif value in _CLOSE and opened:
                    i = opened.pop()
                    tokens[i].partner = len(tokens)
                    tokens.append(Token(PUNCT, value, at, end, i))
                    at = end
                    continue
                tokens.append(Token(PUNCT, value, at, end))
            else:
                tokens.append(Token(kind, text[at:end], at, end))
            at = end


class Islands:
    def __init__(self, text: str):
        self.text = text
        scanner = Scanner(text)
        self.t, self.comments = scanner.tokens, scanner.comments
        self.comment_starts = [c[0] for c in self.comments]
        self.found: list[Island] = []

    def value(self, i: int) -> str:
        return self.t[i].value if 0 <= i < len(self.t) and self.t[i].kind in (NAME, PUNCT) else ""

    def kind(self, i: int) -> int:
        return self.t[i].kind if 0 <= i < len(self.t) else 0

    def all(self) -> list[Island]:
        for i, token in enumerate(self.t):
            if token.kind != NAME or self.value(i - 1) in (".", "?."):
                continue
            if token.value == "function":
                self._declaration(i)
            elif token.value == "const":
                self._assigned(i)
            elif token.value == "class":
                self._class(i)
        return self.found

    # ---- parts of a signature

    def _generics(self, i: int) -> int:
        """Behind a list in angle brackets at i, if there is one."""
        if self.value(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            v = self.value(i)
            if v == "<":
                depth += 1
            elif v == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif v in _OPEN and self.t[i].partner > i:
                i = self.t[i].partner
            i += 1
        return i

    def _type(self, i: int, stops: tuple[str, ...]) -> int:
        """From the start of a type to the first of ``stops`` that cannot belong to it."""
        wants = True
        while i < len(self.t):
            v = self.value(i)
            if not wants and v in stops:
                return i
            if v in (";", ",") or v in _CLOSE:
                return i
            if v == "<":
                i = self._generics(i)
                wants = False
                continue
            if v in _OPEN:
                if self.t[i].partner < i:
                    return len(self.t)
                i = self.t[i].partner
                wants = False
            else:
                wants = v in ("|", "&", "=>", "?", ":", ".", "is", "keyof", "typeof", "extends", "infer", "readonly", "asserts", "unique", "new")
            i += 1
        return i

    def _signature(self, i: int) -> tuple[int, int]:
        """(index of the opening parenthesis, index behind parameters and return type), or (-1, i)."""
        i = self._generics(i)
        if self.value(i) != "(" or self.t[i].partner < 0:
            return -1, i
        opened, i = i, self.t[i].partner + 1
        if self.value(i) == ":":
            i = self._type(i + 1, ("{", "=>", "="))
        return opened, i

    def _params(self, opened: int) -> tuple[str, ...]:
        names, depth, default = [], 0, False
        for j in range(opened + 1, self.t[opened].partner):
            token, before = self.t[j], self.value(j - 1)
            if token.kind == NAME and (j == opened + 1 or before in (",", "{", "[", "...", "(") or before in _MODIFIERS or before == ":" and depth):
                names.append(token.value)
            if token.value in ("{", "["):
                depth += 1
            elif token.value in ("}", "]"):
                depth -= 1
        del default
        return tuple(names)

    def _add(self, first: int, name: int, opened: int, body: int) -> None:
        end = self.t[body].partner
        if end < 0:
            return
        first = self._decorated(first)
        comment = self._comment(first, name)
        self.found.append(Island(self.t[name].value, self.t[name].start, self.t[first].start, self.t[end].end, self._params(opened), comment))

    def _decorated(self, first: int) -> int:
        """The first decorator in front of ``first``."""
        while True:
            i = first - 1
            if self.value(i) == ")" and self.t[i].partner >= 0:
                i = self.t[i].partner - 1
            while self.kind(i) == NAME and self.value(i - 1) == ".":
                i -= 2
            if self.kind(i) == NAME and self.value(i - 1) == "@":
                first = i - 1
            else:
                return first

    def _comment(self, first: int, name: int) -> str:
        """Comments between the code before the declaration and its name; one that stands behind code is not above."""
        low = self.t[first - 1].end if first else 0
        i = bisect_left(self.comment_starts, low)
        parts = []
        while i < len(self.comments) and self.comments[i][0] < self.t[name].start:
            start, end = self.comments[i]
            if not first or "\n" in self.text[low:start]:
                parts.append(self.text[start:end])
            i += 1
        return "\n".join(parts)

    # ---- islands

    def _declaration(self, i: int) -> None:
        name = i + 2 if self.value(i + 1) == "*" else i + 1
        if self.kind(name) != NAME:
            return
        first = i
        while self.value(first - 1) in ("async", "default", "export", "declare"):
            first -= 1
        before = self.value(first - 1)
        if first:
            if before in _EXPRESSION_BEFORE or self.kind(first - 1) == PUNCT and before not in (";", "{", "}", ")", "]", ":", ">"):
                return
            if before == ":" and first == i:  # a label or a case; in an object or a condition it is an expression
                if self.value(first - 3) not in ("case", "{", ";", "}") and self.value(first - 2) != "default":
                    return
        opened, after = self._signature(name + 1)
        if opened >= 0 and self.value(after) == "{":
            self._add(first, name, opened, after)

    def _assigned(self, i: int) -> None:
        name = i + 1
        if self.kind(name) != NAME:
            return
        j = name + 1
        if self.value(j) == ":":
            j = self._type(j + 1, ("=",))
        if self.value(j) != "=":
            return
        j += 1
        first = i
        while self.value(first - 1) in ("export", "declare"):
            first -= 1
        if self.value(j) == "async" and self.value(j + 1) != "=>":
            j += 1
        if self.value(j) == "function":
            j += 1
            if self.value(j) == "*":
                j += 1
            if self.kind(j) == NAME:
                j += 1
            opened, after = self._signature(j)
            if opened >= 0 and self.value(after) == "{":
                self._add(first, name, opened, after)
            return
        if self.kind(j) == NAME and self.value(j + 1) == "=>":
            if self.value(j + 2) == "{" and self.t[j + 2].partner >= 0:
                start = self._decorated(first)
                self.found.append(Island(self.t[name].value, self.t[name].start, self.t[start].start, self.t[self.t[j + 2].partner].end, (self.t[j].value,), self._comment(start, name)))
            return
        opened, after = self._signature(j)
        if opened >= 0 and self.value(after) == "=>" and self.value(after + 1) == "{":
            self._add(first, name, opened, after + 1)

    def _class(self, i: int) -> None:
        j = i + 1
        if not (self.kind(j) == NAME or self.value(j) == "{"):
            return
        heritage = False
        while j < len(self.t) and self.value(j) != "{":
            if self.value(j) == "<":
                j = self._generics(j)
                continue
            if self.value(j) in ("(", "["):
                j = self.t[j].partner
                if j < 0:
                    return
            elif self.value(j) in ("extends", "implements"):
                heritage = True
            elif self.value(j) in (";", ")", ":", "=>", "=") or self.value(j) == "," and not heritage:
                return
            j += 1
        if j >= len(self.t) or self.t[j].partner < 0:
            return
        end, j = self.t[j].partner, j + 1
        while j < end:
            j = self._member(j, end)

    def _member(self, j: int, end: int) -> int:
        if self.value(j) == ";":
            return j + 1
        first = j
        while self.value(j) == "@":
            j += 2
            while self.value(j) == ".":
                j += 2
            if self.value(j) == "(":
                j = self.t[j].partner + 1
        while self.kind(j) == NAME and self.value(j) in _MODIFIERS and (self.kind(j + 1) in (NAME, STRING, NUMBER) or self.value(j + 1) in ("[", "*")):
            j += 1
        if self.value(j) == "static" and self.value(j + 1) == "{":
            return self.t[j + 1].partner + 1
        if self.value(j) == "*":
            j += 1
        name = j
        named = self.kind(j) in (NAME, STRING)
        j = self.t[j].partner + 1 if self.value(j) == "[" else j + 1
        if self.value(j) in ("?", "!"):
            j += 1
        if self.value(j) in ("(", "<"):
            opened, after = self._signature(j)
            if opened >= 0 and self.value(after) == "{":
                if named:
                    self._add(first, name, opened, after)
                return self.t[after].partner + 1 if self.t[after].partner >= 0 else end
            j = after
        # a field or a bodiless signature: to the semicolon, or to a line that begins a member
        while j < end:
            v = self.value(j)
            if v == ";":
                return j + 1
            if j > first + 1 and "\n" in self.text[self.t[j - 1].end : self.t[j].start]:
                goes_on = self.kind(j - 1) == PUNCT and self.value(j - 1) not in (")", "]", "}", ">") or self.kind(j) == PUNCT and v not in ("@", "[", "*", "#")
                if not goes_on:
                    return j
            j = self.t[j].partner + 1 if v in _OPEN and self.t[j].partner > j else j + 1
        return end


# ---- usefulness

_MARKS = re.compile(r"^\s*(?:/{2,}!?|/\*+!?|\*+(?!/)|<!--)?[ \t]?|\s*(?:\*+/|-->)\s*$")
_DIRECTIVE = re.compile(
    r"^@?(?:eslint\b|tslint\b|jshint\b|jslint\b|jscs\b|biome-ignore|prettier-ignore|istanbul\b|c8\b|v8 ignore|ts-(?:ignore|expect-error|nocheck|check)\b|deno-lint|deno-fmt|oxlint|stylelint|cspell|spell-?checker|noinspection|nosonar|webpack\w+\s*:|vite-ignore|__PURE__|#__PURE__|#?region\b|#?endregion\b|sourceMappingURL|#\s*source|jest-environment|vitest-environment|flow\b|globals?\s+\w|exported\s+\w|coverage\b|lint-|rslint|standard:|sonar|nolint|<reference|<amd)",
    re.I,
)
_TODO = re.compile(r"^[\s\-*@\[(]*(?:todo|fixme|xxx|hack|tbd)\b", re.I)
_SEPARATOR = re.compile(r"^\W*$|^[\W_]*([-=*#~_+/.<>])\1{3,}|([-=*#~_+/.<>])\2{3,}[\W_]*$")
_CODE_SIGN = re.compile(r"[;{}()=\[\]]|=>")
_BRACED = re.compile(r"\{[^{}]*\}")
_TAG = re.compile(r"@[A-Za-z][\w\-]*")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\WA-Za-z\d_]+")


def _parses(code: str) -> bool:
    deep_enough(code)
    try:
        return not Parser(code, DIALECTS["tsx"], 1).parse()
    except ParseError:
        return False


def is_code(line: str) -> bool:
    """Whether a line of a comment is a statement (or opens or closes one) and not prose."""
    if not _CODE_SIGN.search(line):
        return False
    bare = line.strip()
    if bare in ("{", "}", "};", "});", ")", ");", "},"):
        return True
    tries = [bare]
    if bare.endswith(("{", "(", "[", ",")):
        closing = {"{": "}", "(": ")", "[": "]"}.get(bare[-1], "")
        tries += [bare + closing, bare + closing + ")", bare.rstrip(",")]
    if bare.startswith("}"):
        tries += ["if (a) {" + bare, "if (a) {" + bare + "}", "try {" + bare + "}"]
    if bare.startswith("return"):
        tries += ["function f() {" + bare + "}"]
    if re.match(r"\(?[\w\s]+\)?$", bare):
        return False
    return any(_parses(t) for t in tries)


def doc_lines(comment: str) -> list[str]:
    """Lines of prose: without comment marks, directives, to-dos, separators and commented-out code."""
    out = []
    for raw in re.split(r"\r?\n", comment):
        line = _MARKS.sub("", _MARKS.sub("", raw, count=1)).strip() if raw.strip() else ""
        line = re.sub(r"\s*\*+/\s*$", "", line).strip()
        if not line or _DIRECTIVE.match(line) or _TODO.match(line) or _SEPARATOR.search(line) or is_code(line):
            continue
        out.append(line)
    return out


def useful_words(comment: str, name: str, params: tuple[str, ...]) -> list[str]:
    """Words of the documentation that say more than the function's name, its parameters and tags do."""
    known = {name.lower(), name.lstrip("#").lower(), *(p.lower() for p in _PART.findall(name)), *(p.lower() for p in params)}
    words = []
    for line in doc_lines(comment):
        line = _TAG.sub(" ", _BRACED.sub(" ", line))
        words += [w for w in _WORD.findall(line) if w.lower() not in known and not w.isdigit()]
    return words


def documented(text: str, least: int = 3) -> list[Island]:
    """Functions whose documentation has at least ``least`` words of its own. A text without any comment has none."""
    if "//" not in text and "/*" not in text:
        return []
    return [i for i in Islands(text).all() if i.comment and len(useful_words(i.comment, i.name, i.params)) >= least]


def _pairs(text: str | None, path: str | None) -> dict:
    """The pairs of one file; a file that is no valid script has none."""
    extension = path.rsplit(".", 1)[-1].lower() if path else ""
    pairs = []
    if text is not None and extension in DIALECTS:
        found = documented(text)
        if found and not script_errors(text, extension, path, 1):
            seen = set()
            for i in found:
                line = text.count("\n", 0, i.name_at) + 1
                if (line, i.name) not in seen:
                    seen.add((line, i.name))
                    pairs.append({"name": i.name, "declaration_line": line, "doc": "\n".join(doc_lines(i.comment)), "code": text[i.start : i.end]})
    return {"pairs": pairs}


def documented_functions(files: DataFrame) -> DataFrame:
    """Pairs of code and documentation, one row per function.

    Files are read and scanned whole where they are stored; only files that yield a candidate are parsed for validity.
    Of repeated deliveries the last holds. Null texts or paths, other languages and invalid scripts give no rows; extra
    columns are ignored. A file that could not be searched gives one row with ``error`` and without a function; ``error``
    is null in all others.
    """
    scripts = files.where(language().isin(list(DIALECTS)))
    rows = per_file(scripts, _pairs, "pairs array<struct<name string, declaration_line int, doc string, code string>>", keep=["repo", "display_path"])
    told = rows.where((F.size("pairs") > 0) | F.col("error").isNotNull())
    return told.select("file_id", "repo", "display_path", "error", F.inline_outer("pairs")).select("file_id", "repo", "display_path", "name", "declaration_line", "doc", "code", "error")


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of a function's code and its documentation, and in ``error`` the files that could not be searched."""
    return documented_functions(table(spark, folder, "files"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Where documented functions are declared. Its rows have no place for a file that could not be searched, and without
    one it would pass for a file without such functions: it ends the query, and ``p1_pairs`` gives the rest."""
    rows = documented_functions(table(spark, folder, "files"))
    failed = F.raise_error(F.format_string("file %s (%s) could not be searched: %s", "file_id", "display_path", "error")).cast("int")
    line = F.when(F.col("error").isNull(), F.col("declaration_line")).otherwise(failed)
    return rows.select("file_id", line.alias("declaration_line")).distinct()


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs}
SQL: dict[str, str] = {}
