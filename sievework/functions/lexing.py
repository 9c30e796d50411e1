"""Lexers of the core: masking, comments, callable blocks and import statements of script text.

They run inside Arrow batches, once per file, and everything that can be a column expression works on what they yield.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from sievework.functions.patterns import python

_STEP = re.compile(
    r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"
    r"|(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|\Z))"
    r"|(?P<template>`)|(?P<slash>/)|(?P<word>[A-Za-z0-9_$]+)|(?P<brace>[{}])|(?P<other>\S)"
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\\\]\n]|\\[^\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_BEFORE_REGEX = frozenset("([{=,:!&|?;")


def _blank(text: str) -> str:
    return re.sub(r"[^\n\r]", " ", text)


@dataclass(frozen=True)
class Comment:
    kind: str
    text: str
    line: int
    end_line: int
    start: int
    end: int


class Lexed:
    """A script with its mask (same length; comments and the bodies of strings, regular expressions and templates are
    blank, code in ``${}`` stays) and its comments."""

    def __init__(self, text: str):
        self.text = text
        out: list[str] = []
        self.spans: list[tuple[int, int]] = []
        at, last, previous = 0, 0, ""
        holes: list[int] = []
        depth = 0
        while True:
            m = _STEP.search(text, at)
            if not m:
                break
            kind, low, high = m.lastgroup, m.start(), m.end()
            if kind == "comment":
                out += [text[last:low], _blank(text[low:high])]
                self.spans.append((low, high))
                at = last = high
                continue
            if kind == "string":
                closed = high - low > 1 and text[high - 1] == text[low]
                out += [text[last : low + 1], _blank(text[low + 1 : high - closed]), text[high - 1 : high] if closed else ""]
                at = last = high
                previous = text[low]
                continue
            if kind == "template" or kind == "brace" and text[low] == "}" and holes and holes[-1] == depth:
                if kind == "brace":
                    holes.pop()
                    depth -= 1
                body = _TEMPLATE.match(text, high).end()
                out += [text[last:high], _blank(text[high:body])]
                last = at = body
                if text.startswith("${", body):
                    depth += 1
                    holes.append(depth)
                    at = body + 2
                    previous = "{"
                elif body < len(text):
                    at = body + 1
                    previous = "`"
                continue
            if kind == "brace":
                depth += 1 if text[low] == "{" else -1
            if kind == "slash" and (not previous or previous in _BEFORE_REGEX or previous == "return"):
                r = _REGEX.match(text, low)
                if r:
                    body = r.group().rfind("/")
                    out += [text[last : low + 1], _blank(text[low + 1 : low + body])]
                    last = low + body
                    at = r.end()
                    previous = "/"
                    continue
            previous = m.group() if kind == "word" else text[high - 1]
            at = high
        out.append(text[last:])
        self.masked = "".join(out)
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect_right(self.line_starts, at)

    def comments(self) -> list[Comment]:
        found = []
        for low, high in self.spans:
            raw = self.text[low:high]
            if raw.startswith("//"):
                kind, body = "line", raw[2:]
            else:
                kind, body = "block", re.sub(r"\*/\Z", "", raw[2:])
            lines = [re.sub(r"^[ \t]*\*[ \t]?", "", x).strip() for x in body.split("\n")]
            found.append(Comment(kind, " ".join(x for x in lines if x).strip(), self.line(low), self.line(max(low, high - 1)), low, high))
        return found


def mask_code(text: str) -> str:
    return Lexed(text).masked


def mask_templates(lexed: Lexed) -> str:
    """The text with only the bodies of its templates blank, so that quoted text of code stays readable."""
    out, last = [], 0
    for m in re.finditer(r"`(?:[^`\\]|\\[\s\S])*`", lexed.text):
        if lexed.masked[m.start()] == "`":
            out += [lexed.text[last : m.start() + 1], _blank(m.group()[1:-1])]
            last = m.end() - 1
    return "".join([*out, lexed.text[last:]])


@dataclass(frozen=True)
class Block:
    name: str
    params: str
    start_line: int
    line_count: int
    body: str
    code_body: str
    is_public: bool
    is_exported: bool
    is_test: bool
    has_leading_comment: bool
    declaration_line: int


_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
# What begins a callable, in the order in which it is tried. Fixed values.
_TEST = python(r"^\s*(?:test|it)\s*\(")
_TEST_CALL = python(r"^\s*(?:test|it)\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,\s*(?:async\s*)?\(([^)]*)\)\s*=>")
_CALLABLES = (
    python(rf"^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+({_NAME})\s*\(([^)]*)\)"),
    python(rf"^\s*(?:public|private|protected)?\s*(?:async\s+)?({_NAME})\s*\(([^)]*)\)\s*[:{{]"),
    python(rf"^\s*(?:export\s+)?(?:const|let)\s+({_NAME})\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>"),
)
_CONTROL = frozenset("if for while switch catch".split())
_CLASS_LIKE = python(rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+({_NAME})\b")


def _closed(lines: list[str], first: int) -> int | None:
    """The line on which the braces that open from ``first`` on are closed again."""
    depth, opened = 0, False
    for i in range(first, len(lines)):
        opened = opened or "{" in lines[i]
        depth += lines[i].count("{") - lines[i].count("}")
        if opened and depth <= 0:
            return i
    return None


def _end(lines: list[str], first: int) -> int:
    """The last line of the block declared on ``first``. An arrow without a brace behind it ends with its statement."""
    head, arrow, tail = lines[first].partition("=>")
    if arrow and "{" not in tail:
        if tail.strip().endswith(";"):
            return first
        for i in range(first + 1, len(lines)):
            if not lines[i].strip():
                return i - 1
            if lines[i].strip().endswith(";"):
                return i
        return first
    end = _closed(lines, first)
    return len(lines) - 1 if end is None else end


def _head(line: str, raw: str) -> re.Match | None:
    tests = [_TEST_CALL.match(raw)] if _TEST.match(line) else []
    return next((m for m in (*tests, *(p.match(line) for p in _CALLABLES)) if m and m.group(1) not in _CONTROL), None)


def is_commented(raw: list[str], first: int) -> bool:
    """Whether the next line above ``first`` that is not blank belongs to a comment that says something."""
    i = first - 1
    while i >= 0 and not raw[i].strip():
        i -= 1
    text = raw[i].strip() if i >= 0 else ""
    if text.startswith("//"):
        return text[2:].strip() != ""
    if not text.startswith("/*") and not text.endswith("*/"):
        return False
    low = i
    while low > 0 and not raw[low].strip().startswith("/*"):
        low -= 1
    high = i
    while high < len(raw) - 1 and "*/" not in raw[high]:
        high += 1
    if not raw[low].strip().startswith("/*") or "*/" not in raw[high]:
        return False
    said = (re.sub(r"^\s*\*\s?", "", re.sub(r"\*/\s*$", "", re.sub(r"^\s*/\*\*?", "", x))).strip() for x in raw[low : high + 1])
    return any(x and not x.startswith("@") for x in said)


def blocks(lexed: Lexed) -> list[Block]:
    """Functions, methods, arrow functions and test callbacks, told line by line. A block begins with the decorators, the
    documentation block and the blank lines right above its declaration."""
    raw = re.split(r"\r?\n", lexed.text)
    code = re.split(r"\r?\n", lexed.masked)
    exported = {m.group(1) for m in python(rf"^\s*export\s+default\s+({_NAME})\s*;?\s*$", re.M).finditer(lexed.masked)}
    for m in python(r"export\s*\{([^}]+)\}(?!\s*from\b)").finditer(lexed.masked):
        exported |= {re.split(r"\s+as\s+", part.strip())[0] for part in m.group(1).split(",")}
    found = []
    for i, line in enumerate(code):
        m = _head(line, raw[i])
        if not m:
            continue
        end, start = _end(code, i), i
        while start and ((above := raw[start - 1].strip()) == "" or above.startswith(("@", "/**", "*"))):
            start -= 1
        head = "\n".join(code[start : i + 1])
        found.append(Block(m.group(1), m.group(2) or "", start + 1, end - start + 1, "\n".join(raw[start : end + 1]), "\n".join(code[start : end + 1]), bool(python(r"\b(?:export|public)\b").search(head)), bool(python(r"^\s*export\b").match(line)) or m.group(1) in exported, bool(_TEST.match(line)), is_commented(raw, i), i + 1))
    return found


@dataclass(frozen=True)
class Region:
    """Lines of a declaration, by its name."""

    name: str
    start: int
    end: int


def regions(lexed: Lexed, found: list[Block]) -> list[Region]:
    """Where changes are looked for around a finding: callables, classes and interfaces."""
    code = re.split(r"\r?\n", lexed.masked)
    out = [Region(b.name, b.start_line, b.start_line + b.line_count - 1) for b in found]
    for i, line in enumerate(code):
        m = _CLASS_LIKE.match(line)
        if m:
            end = _closed(code, i)
            out.append(Region(m.group(1), i + 1, i + 1 if end is None else end + 1))
    return out


@dataclass(frozen=True)
class Import:
    specifier: str
    line: int
    parents: int
    type_only: bool


def imports(lexed: Lexed) -> list[Import]:
    """Relative imports and re-exports, also over several lines. Templates hold none."""
    found = []
    readable = mask_templates(lexed)
    for m in python(r"\b(?:import|export)\b[^;\"'`]*?[\"']").finditer(lexed.masked):
        line_start = readable.rfind("\n", 0, m.start()) + 1
        if lexed.masked[line_start : m.start()].strip():
            continue
        close = readable.find(readable[m.end() - 1], m.end())
        specifier = readable[m.end() : close]
        if specifier.startswith("."):
            found.append(Import(specifier, lexed.line(m.start()), specifier.split("/").count(".."), bool(python(r"(?:import|export)\s+type\b").match(m.group()))))
    return found


def delimiter_error(masked: str) -> tuple[str, int] | None:
    """The first bracket that closes what was not opened, as (bracket, line); brackets left open are no error."""
    depth = {"(": 0, "[": 0, "{": 0}
    pairs = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[()\[\]{}]", masked):
        c = m.group()
        if c in depth:
            depth[c] += 1
        else:
            depth[pairs[c]] -= 1
            if depth[pairs[c]] < 0:
                return c, masked.count("\n", 0, m.start()) + 1
    return None


def parameters(params: str) -> list[tuple[str, str]]:
    """(name, what the parameter is written as without modifier and dots); destructured ones are left out."""
    out = []
    for part in params.split(","):
        bare = re.sub(r"^\.\.\.", "", python(r"^(?:public|private|protected|readonly)\s+").sub("", part.strip()))
        name = re.split(r"[?:=]", bare)[0].strip()
        if re.fullmatch(_NAME, name):
            out.append((name, bare))
    return out


def parameter_names(params: str) -> list[str]:
    return [name for name, _ in parameters(params)]
