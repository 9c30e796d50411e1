"""Syntax checks for JSON (strict, and with comments and trailing commas) and for YAML block and flow structure."""

from __future__ import annotations

import json
import re

from sievework.llm.script_parser import deep_enough

_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"')
_JSONC_SKIP = re.compile(r'"(?:[^"\\\n]|\\.)*"|//[^\n]*|/\*[\s\S]*?\*/|,(?=(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*[}\]])')


def _no_constant(name: str):
    raise ValueError(f"constant {name}")


def json_errors(text: str, relaxed: bool = False) -> list[tuple[int, str]]:
    """All errors of a JSON text. A byte order mark in front is accepted; ``relaxed`` accepts comments and trailing
    commas. The standard library's parser judges the text; one with recovery goes over what it refuses."""
    if text.startswith("﻿"):
        text = " " + text[1:]
    if relaxed:
        # same length, so that offsets hold
        text = _JSONC_SKIP.sub(lambda m: m.group() if m.group()[0] == '"' else re.sub(r"[^\n]", " ", m.group()), text)
    try:
        json.loads(text, parse_constant=_no_constant)
    except json.JSONDecodeError as x:
        return [(x.pos, x.msg), *_Json(text).errors()[1:]]
    except RecursionError:  # deeper than the library reads; the other parser knows no depth
        return _Json(text).errors()
    except ValueError as x:
        return _Json(text).errors() or [(0, str(x)[:200])]
    return []


_JSON_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\\n]|\\[^\n])*")|((?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)(?![\w.+\-]))|($(?!\n))|([\s\S]))', re.A)
_JSON_ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|(\\u)|(\\)|([\x00-\x1f])')
# What stands for a key or value although it is none: up to the next mark, blank or quote, or quoted in another way.
_JSON_WORD = re.compile(r"'(?:[^'\\\n]|\\[^\n])*'|`[^`\n]*`|[^\s,:\[\]{}\"]+")
_JSON_REST = re.compile(r"[^,\[\]{}\n]*")


class _Json:
    """Errors of a JSON text with panic-mode recovery: behind one, reading goes on with the next mark, line, key or value.
    Open containers are kept in a list, so that depth is no matter."""

    def __init__(self, text: str):
        self.text = text
        self.found: list[tuple[int, str]] = []

    def note(self, at: int, message: str) -> None:
        self.found.append((at, message))

    def string(self, at: int, value: str) -> None:
        for m in _JSON_ESCAPE.finditer(value):
            if m.lastindex:
                self.note(at + m.start(), ("Invalid \\uXXXX escape", "Invalid \\escape", "Invalid control character at")[m.lastindex - 1])

    def errors(self) -> list[tuple[int, str]]:
        text, at, comma, extra = self.text, 0, 0, False
        stack: list[str] = []
        state = "value"  # first (or end), key, colon, value, comma (or end), over
        while True:
            m = _JSON_TOKEN.match(text, at)
            kind, start, end = m.lastindex, m.start(m.lastindex), m.end()
            mark = m.group(1)
            if kind == 4:
                if state != "over":
                    self.note(start, {"key": "Expecting property name enclosed in double quotes", "colon": "Expecting ':' delimiter", "comma": "Expecting ',' delimiter", "first": "Expecting value" if stack and stack[-1] == "[" else "Expecting property name enclosed in double quotes"}.get(state, "Expecting value"))
                return self.found
            if state == "over":
                if not extra:
                    self.note(start, "Extra data")
                extra = True
                if kind in (3, 5) or mark and mark not in "{[":
                    at = end if kind != 5 else max(end, _JSON_REST.match(text, start).end())
                    continue
                state = "value"  # what follows is read for errors inside of it
            inside = stack[-1] if stack else ""
            if mark and mark in "]}":
                opener = "[" if mark == "]" else "{"
                if opener not in stack:
                    self.note(start, "Expecting value" if state == "value" else f"Unexpected {mark!r}")
                    at = end
                    continue
                if inside != opener:
                    self.note(start, "Expecting value" if state == "value" else "Expecting ',' delimiter" if state == "comma" else f"Unexpected {mark!r}")
                    while stack[-1] != opener:
                        stack.pop()
                elif state == "key" or state == "value" and inside == "[":
                    self.note(comma, f"Illegal trailing comma before end of {'array' if mark == ']' else 'object'}")
                elif state in ("colon", "value"):
                    self.note(start, "Expecting ':' delimiter" if state == "colon" else "Expecting value")
                stack.pop()
                state, at = "comma" if stack else "over", end
                continue
            if state == "comma":
                if mark == ",":
                    comma, state, at = start, "key" if inside == "{" else "value", end
                    continue
                self.note(start, "Expecting ',' delimiter")
                state = "key" if inside == "{" else "value"
                if kind == 5 and text[start] != '"' or mark == ":":  # nothing that could be an entry
                    at = max(end, _JSON_REST.match(text, start).end())
                    state = "comma"
                    continue
                # the entry itself is read as if the comma were there
            if state == "first":
                state = "key" if inside == "{" else "value"
            if state == "colon":
                if mark == ":":
                    state, at = "value", end
                    continue
                self.note(start, "Expecting ':' delimiter")
                if mark == ",":
                    comma, state, at = start, "key", end
                    continue
                if kind == 5 and text[start] != '"':
                    at = max(end, _JSON_REST.match(text, start).end())
                    state = "comma"
                    continue
                state = "value"
            # a key or a value
            if kind == 2:
                self.string(start, m.group(2))
                at = end
            elif kind == 5 and text[start] == '"':
                stop = text.find("\n", start)
                stop = len(text) if stop < 0 else stop
                self.note(*((start, "Unterminated string starting at") if stop == len(text) else (stop, "Invalid control character at")))
                at = stop
                # the line ends where the string should have; what comes next tells whether a mark is missing
                nxt = _JSON_TOKEN.match(text, at)
                if nxt.lastindex != 4 and state == "value":
                    state = "comma"
                    if nxt.group(1) not in (",", "]", "}"):
                        state = "key" if inside == "{" else "value" if inside else "over"
                elif nxt.lastindex != 4 and nxt.group(1) not in (":",):
                    state = "first"
                else:
                    state = "colon" if state == "key" else "comma" if stack else "over"
                if nxt.lastindex == 4:
                    return self.found
                continue
            elif state == "key":
                if kind in (3, 5) or mark in ("{", "["):
                    self.note(start, "Expecting property name enclosed in double quotes")
                if mark == ",":
                    self.note(start, "Expecting property name enclosed in double quotes")
                    comma, at = start, end
                    continue
                if mark == ":":
                    self.note(start, "Expecting property name enclosed in double quotes")
                    state, at = "value", end
                    continue
                if mark:
                    stack.append(mark)
                    state, at = "first", end
                    continue
                if kind == 5:
                    word = _JSON_WORD.match(text, start)
                    at = max(end, word.end()) if word else end
                    if _JSON_TOKEN.match(text, at).group(1) != ":":  # no key either: the line is skipped
                        at = _JSON_REST.match(text, at).end()
                        state = "first" if _JSON_TOKEN.match(text, at).group(1) != "," else "comma"
                        continue
                else:
                    at = end
            elif mark in ("{", "["):
                stack.append(mark)
                state, at = "first", end
                continue
            elif mark:  # a comma or colon in place of a value
                self.note(start, "Expecting value")
                at = end
                if mark == ",":
                    comma, state = start, "key" if inside == "{" else "value"
                continue
            elif kind == 3:
                at = end
            else:
                self.note(start, "Expecting value")
                word = _JSON_WORD.match(text, start)
                at = max(end, word.end()) if word else end
                if _JSON_TOKEN.match(text, at).lastindex == 5 and text[at : at + 1] != "\n":
                    at = _JSON_REST.match(text, at).end()
            state = "colon" if state == "key" else "comma" if stack else "over"


class YamlError(Exception):
    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


_KEY = re.compile(
    r"(?:(?:[&!][^\s,\[\]{}]*[ \t]+)*)"
    r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|\*[^\s,\[\]{}]+|(?![&*!|>@`%\"'#,\[\]{}]|[-?:](?:\s|$))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#:]|:\S))+)?"
    r"[ \t]*:(?=\s|$)"
)
_PROPERTY = re.compile(r"(?:[&!][^\s]*(?:[ \t]+|(?=\n)|$))+")
_BLOCK = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-]?)[ \t]*(?:(?<=[ \t])#.*)?$")
_DOUBLE = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*\"")
_SINGLE = re.compile(r"'(?:[^']|'')*'")
_FLOW_MARK = re.compile(r"[\[\]{}]|\n *(?=[^\s#])|(?<=[\s,:\[{])(?:\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*')|(?<=\s)#[^\n]*")
_FLOW_PLAIN = re.compile(r"(?:[^\s,\[\]{}:#\"'&*!|>@`%]|:(?![\s,\[\]{}]|$)|-(?=\S))(?:[^\s,\[\]{}:#]|:(?![\s,\[\]{}]|$)|(?<=\S)#|[ \t]+(?=[^\s,\[\]{}:#]|:(?![\s,\[\]{}]|$)))*")


class Yaml:
    """Recursive descent over indented lines; a document is a stack of block collections by indentation. Panic-mode
    recovery: a collection notes an error in one of its entries and goes on with the next line that is not indented by
    more than itself; within a closed flow collection, with its next item."""

    def __init__(self, text: str):
        self.text = text
        self.lines: list[tuple[int, str]] = []
        at = 1 if text.startswith("﻿") else 0
        for line in text[at:].split("\n"):
            self.lines.append((at, line[:-1] if line.endswith("\r") else line))
            at += len(line) + 1
        self.i = 0
        self.errors: list[tuple[int, str]] = []
        self.until: int | None = None

    def note(self, x: YamlError) -> None:
        if all(at != x.at for at, _ in self.errors[-20:]):
            self.errors.append((x.at, x.message))

    def recover(self, x: YamlError, indent: int) -> None:
        """Notes ``x`` and skips its line, and those behind it that are indented by more than ``indent`` or with tabs or
        only close brackets."""
        self.note(x)
        if x.at < len(self.text):  # an error at the end belongs to the line where the value begins
            while self.i + 1 < len(self.lines) and self.lines[self.i + 1][0] <= x.at:
                self.i += 1
        self.i += 1
        while self.i < len(self.lines) and not self.marker():
            line = self.lines[self.i][1]
            body = line.lstrip(" ")
            if body and not body.startswith("#") and len(line) - len(body) <= indent and not body.startswith("\t") and not re.fullmatch(r"[\]},\s]+", body):
                return
            self.i += 1

    def skip(self) -> None:
        while self.i < len(self.lines):
            body = self.lines[self.i][1].lstrip(" \t")
            if body and not body.startswith("#"):
                return
            self.i += 1

    def here(self) -> tuple[int, str, int]:
        """Indentation, body and offset of the current line."""
        at, line = self.lines[self.i]
        body = line.lstrip(" ")
        indent = len(line) - len(body)
        if body.startswith("\t"):
            raise YamlError(at + indent, "tab in indentation")
        return indent, body, at + indent

    def check(self) -> None:
        """Reads all documents; what is wrong is in ``errors`` in the order found."""
        while True:
            try:
                self.documents()
                return
            except YamlError as x:
                at = self.lines[self.i][1] if self.i < len(self.lines) else ""
                self.recover(x, len(at) - len(at.lstrip(" ")))

    def documents(self) -> None:
        while True:
            self.skip()
            while self.i < len(self.lines) and self.lines[self.i][1].startswith("%"):
                self.i += 1
                self.skip()
            if self.i >= len(self.lines):
                return
            line = self.lines[self.i][1]
            if line == "..." or line.startswith("... "):
                self.i += 1
                continue
            if re.match(r"---(?:\s|$)", line):
                rest = line[3:].strip()
                if not rest or rest.startswith("#"):
                    self.i += 1
                    self.skip()
                    if self.i >= len(self.lines) or self.marker():
                        continue
                else:
                    at, _ = self.lines[self.i]
                    self.lines[self.i] = (at, "   " + line[3:])
            self.node(-1)
            self.skip()
            if self.i < len(self.lines) and not self.marker():
                raise YamlError(self.here()[2], "content outside of the structure")

    def marker(self) -> bool:
        return bool(re.match(r"(?:---|\.\.\.)(?:\s|$)", self.lines[self.i][1]))

    def node(self, parent: int) -> None:
        """A block node whose lines are indented by more than ``parent``."""
        indent, body, at = self.here()
        if indent <= parent:
            return
        if re.match(r"-(?:\s|$)", body):
            self.sequence(indent)
        elif self.is_key(body) or re.match(r"\?(?:\s|$)", body):
            self.mapping(indent)
        else:
            self.scalar(body, at, parent)

    def is_key(self, body: str) -> bool:
        return bool(_KEY.match(body))

    def sequence(self, indent: int) -> None:
        while True:
            self.skip()
            if self.i >= len(self.lines) or self.marker():
                return
            try:
                now, body, at = self.here()
                if now < indent or now == indent and not re.match(r"-(?:\s|$)", body):
                    return
                if now > indent:
                    raise YamlError(at, "unexpected indentation")
                self.entry(body[1:], at + 1, indent, indent)
            except YamlError as x:
                self.recover(x, indent)

    def entry(self, rest: str, at: int, indent: int, parent: int) -> None:
        """What follows an indicator on its line: nothing, a nested collection, or a value."""
        inner = rest.lstrip(" ")
        if inner.startswith("\t"):
            inner = inner.lstrip(" \t")
            if re.match(r"-(?:\s|$)", inner) or self.is_key(inner):
                raise YamlError(at, "tab before a nested collection")
        if not inner or inner.startswith("#"):
            self.i += 1
            self.skip()
            if self.i < len(self.lines) and not self.marker():
                self.node(parent)
            return
        column = at - self.lines[self.i][0] + len(rest) - len(inner)
        if re.match(r"-(?:\s|$)", inner) or self.is_key(inner) or re.match(r"\?(?:\s|$)", inner):
            start, _ = self.lines[self.i]
            self.lines[self.i] = (start, " " * column + inner)
            self.node(parent)
            return
        self.value(inner, at + len(rest) - len(inner), parent)

    def mapping(self, indent: int) -> None:
        while True:
            self.skip()
            if self.i >= len(self.lines) or self.marker():
                return
            try:
                now, body, at = self.here()
                if now < indent:
                    return
                if now > indent:
                    raise YamlError(at, "unexpected indentation")
                if re.match(r"\?(?:\s|$)", body):
                    self.entry(body[1:], at + 1, indent, indent)
                    continue
                m = _KEY.match(body)
                if not m:
                    if re.match(r"-(?:\s|$)", body):
                        return
                    raise YamlError(at, "expected a key")
                rest = body[m.end() :]
                self.mapped(rest, at + m.end(), indent)
            except YamlError as x:
                self.recover(x, indent)

    def mapped(self, rest: str, at: int, indent: int) -> None:
        inner = rest.strip(" \t")
        m = _PROPERTY.match(inner)
        bare = inner[m.end() :] if m else inner
        if not bare or bare.startswith("#"):
            self.i += 1
            self.skip()
            if self.i >= len(self.lines) or self.marker():
                return
            now, body, _ = self.here()
            if now == indent and re.match(r"-(?:\s|$)", body):
                self.sequence(now)
            else:
                self.node(indent)
            return
        self.value(inner, at + len(rest) - len(rest.lstrip(" \t")), indent)

    def value(self, body: str, at: int, parent: int) -> None:
        m = _PROPERTY.match(body)
        if m:
            at += m.end()
            body = body[m.end() :]
        if not body:
            self.i += 1
            return
        first = body[0]
        if first in "|>":
            if not _BLOCK.match(body.rstrip()):
                raise YamlError(at, "malformed block scalar header")
            self.block_scalar(parent)
        elif first in "[{":
            self.flow_value(at, parent)
        elif first in "\"'":
            self.quoted_value(at, parent)
        elif first in "@`%":
            raise YamlError(at, f"{first!r} cannot begin a value")
        elif first in "]},":
            raise YamlError(at, f"unexpected {first!r}")
        elif re.match(r"-(?:\s|$)", body):
            raise YamlError(at, "sequence entry not allowed here")
        else:
            text = re.split(r"[ \t]#", body)[0]
            colon = re.search(r":(?=[ \t]|$)", text)
            if colon and not (first == "*" and False):
                raise YamlError(at + colon.start(), "mapping value not allowed here")
            commented = text != body
            self.i += 1
            self.continuation(parent, commented)

    def scalar(self, body: str, at: int, parent: int) -> None:
        self.value(body, at, parent)

    def continuation(self, parent: int, ended: bool) -> None:
        """Further lines of a plain scalar."""
        while self.i < len(self.lines):
            at, line = self.lines[self.i]
            body = line.strip(" \t")
            if not body:
                self.i += 1
                continue
            indent = len(line) - len(line.lstrip(" "))
            if indent <= parent or self.marker():
                return
            if body.startswith("#"):
                ended = True
                self.i += 1
                continue
            if line[indent:].startswith("\t") and parent < 0:
                pass
            text = re.split(r"[ \t]#", body)[0]
            if ended or re.search(r":(?=[ \t]|$)", text):
                raise YamlError(at + indent, "mapping value not allowed here")
            ended = text != body
            self.i += 1

    def block_scalar(self, parent: int) -> None:
        self.i += 1
        needed = None
        while self.i < len(self.lines):
            at, line = self.lines[self.i]
            if not line.strip(" "):
                self.i += 1
                continue
            indent = len(line) - len(line.lstrip(" "))
            if needed is None:
                if indent <= parent:
                    return
                needed = indent
            if indent < needed:
                if indent > parent and not line.lstrip(" ").startswith("#"):
                    raise YamlError(at + indent, "less indented line in a block scalar")
                return
            self.i += 1

    def resume(self, end: int, parent: int) -> None:
        """Goes on behind a value that may have spanned lines; only a comment may follow on its last line."""
        while self.i + 1 < len(self.lines) and self.lines[self.i + 1][0] <= end:
            self.i += 1
        at, line = self.lines[self.i]
        rest = line[end - at :]
        if rest.strip(" \t") and not re.match(r"[ \t]+#", rest):
            raise YamlError(end, "unexpected text behind a value")
        self.i += 1

    def quoted_value(self, at: int, parent: int) -> None:
        m = (_DOUBLE if self.text[at] == '"' else _SINGLE).match(self.text, at)
        if not m:
            raise YamlError(at, "unterminated quoted scalar")
        if self.text[at] == '"':
            wrong = re.search(r"(?<!\\)(?:\\\\)*\\([^0abt\tnvfre \"/\\N_LPxuU\n\r])", m.group())
            if wrong:
                raise YamlError(at + wrong.start(1), "unknown escape")
        self.indented(at, m.end(), parent)
        self.resume(m.end(), parent)

    def indented(self, start: int, end: int, parent: int) -> None:
        """Further lines of a value have to be indented by more than its parent."""
        for line in re.finditer(r"\n( *)([^\r\n ])", self.text[start:end]):
            if len(line.group(1)) <= parent:
                raise YamlError(start + line.start(2), "line of a value is not indented")

    def flow_value(self, at: int, parent: int) -> None:
        try:
            end = self.flow(at)
        except YamlError as x:
            self.until = self.closed(at, parent)
            if self.until is None:
                raise
            self.note(x)
            try:  # again, item by item
                end = self.flow(at)
            finally:
                self.until = None
        self.indented(at, end, parent)
        self.resume(end, parent)

    def closed(self, at: int, parent: int) -> int | None:
        """The offset behind the flow collection at ``at`` if it is closed before a line that belongs to its parent."""
        depth = 0
        for m in _FLOW_MARK.finditer(self.text, at):
            mark = m.group()
            if mark in ("[", "{"):
                depth += 1
            elif mark in ("]", "}"):
                depth -= 1
                if not depth:
                    return m.end()
            elif mark[0] == "\n" and len(mark) - 1 <= parent:
                return None
        return None

    def space(self, at: int) -> int:
        m = re.compile(r"(?:[ \t\r\n]+(?:#[^\n]*)?)*").match(self.text, at)
        return m.end()

    def flow(self, at: int) -> int:
        """A flow collection or scalar from ``at``; returns the offset behind it."""
        text = self.text
        if at >= len(text):
            raise YamlError(at, "unterminated flow collection")
        c = text[at]
        if c in "&!*":
            m = re.compile(r"[&!*][^\s,\[\]{}]*").match(text, at)
            at = self.space(m.end())
            if c == "*" or at < len(text) and text[at] in ",]}":
                return at
            return self.flow(at)
        if c in "\"'":
            m = (_DOUBLE if c == '"' else _SINGLE).match(text, at)
            if not m:
                raise YamlError(at, "unterminated quoted scalar")
            return m.end()
        if c not in "[{":
            m = _FLOW_PLAIN.match(text, at)
            if not m:
                raise YamlError(at, f"unexpected {c!r} in a flow collection")
            end = m.end()
            while True:  # a plain scalar may go on in the next line
                nxt = re.compile(r"[ \t]*\r?\n[ \t]*(?=[^\s,\[\]{}:#])").match(text, end)
                more = _FLOW_PLAIN.match(text, nxt.end()) if nxt else None
                if not more:
                    return end
                end = more.end()
        close = "]" if c == "[" else "}"
        start = at
        at = self.space(at + 1)
        while True:
            if at >= len(text):
                raise YamlError(start, "unterminated flow collection")
            if text[at] == close:
                return at + 1
            try:
                at = self.flow_item(at, close)
            except YamlError as x:
                if self.until is None:
                    raise
                self.note(x)
                at = self.flow_next(max(x.at, at))
                if at >= self.until:
                    return self.until
                at = at if text[at] == close else self.space(at + 1)

    def flow_item(self, at: int, close: str) -> int:
        """An entry of a flow collection and the comma behind it."""
        text = self.text
        if text[at] == "?" and at + 1 < len(text) and text[at + 1] in " \n\t":
            at = self.space(at + 1)
        if text[at : at + 1] != ":":
            at = self.space(self.flow(at))
        if text[at : at + 1] == ":":
            at = self.space(at + 1)
            if text[at : at + 1] not in (",", close, ""):
                at = self.space(self.flow(at))
        if text[at : at + 1] == ",":
            return self.space(at + 1)
        if text[at : at + 1] != close:
            raise YamlError(min(at, len(text)), "expected ',' or the end of a flow collection" if at < len(text) else "unterminated flow collection")
        return at

    def flow_next(self, at: int) -> int:
        """The next comma or closing bracket from ``at``, past nested collections."""
        depth = 0
        for at in range(at, self.until):
            c = self.text[at]
            if depth == 0 and c in ",]}":
                return at
            depth += (c in "[{") - (c in "]}")
        return self.until


def yaml_errors(text: str) -> list[tuple[int, str]]:
    """All structural errors of a YAML text in the order found. An empty text is an empty stream and valid."""
    yaml = Yaml(text)
    deep_enough(text)
    yaml.check()
    return yaml.errors
