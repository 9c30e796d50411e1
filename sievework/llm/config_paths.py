"""Configuration formats as key paths with offsets: JSON, YAML, TOML, XML, and INI with its kin.

Each reader yields (key path, start, end) for every scalar value, where the offsets are those of the value without its
quotes. Readers do not judge validity: a broken file is read as far as its marks go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Pair = tuple[list[str], int, int]

# ---- JSON

_JSON_TOKEN = re.compile(r'"((?:[^"\\\n]|\\.)*)"|([{}\[\],:])|//[^\n]*|/\*[\s\S]*?\*/|[^\s{}\[\],:"]+')


def json_pairs(text: str) -> Iterator[Pair]:
    path: list[str] = []
    stack: list[str] = []
    key, wants_value = "", False
    for m in _JSON_TOKEN.finditer(text):
        mark = m.group(2)
        if mark in ("{", "["):
            path.append(key)
            stack.append(mark)
            key, wants_value = (key if mark == "[" else ""), mark == "["
        elif mark in ("}", "]"):
            if stack:
                stack.pop()
                key = path.pop()
            wants_value = False
        elif mark == ":":
            wants_value = True
        elif mark == ",":
            wants_value = bool(stack) and stack[-1] == "["
        elif m.group(1) is not None:
            if wants_value:
                yield [*path, key], m.start(1), m.end(1)
            else:
                key = m.group(1)


# ---- YAML

_YAML_KEY = re.compile(r"(?:\"((?:[^\"\\\n]|\\.)*)\"|'([^'\n]*)'|([^\s#'\"\-\[\]{},][^#:\n]*?|-[^\s:\n][^:\n]*?)) *:(?=\s|$)[ \t]*")
_YAML_PROPERTY = re.compile(r"(?:[&!]\S+[ \t]+)*")
_YAML_BLOCK = re.compile(r"[|>][+\-\d]*[ \t]*(?:#[^\n]*)?\r?$")
_QUOTED = re.compile(r"\"((?:[^\"\\]|\\[\s\S])*)\"|'((?:[^']|'')*)'")
_FLOW_PLAIN = re.compile(r"[^\s,\[\]{}#\"'][^,\[\]{}\n]*?(?=\s*(?:[,\[\]{}\n]|:(?:\s|$)|\s#|\Z))")
_FLOW_SPACE = re.compile(r"(?:\s+|#[^\n]*)*")


def _flow(text: str, at: int, limit: int, path: list[str], out: list[Pair]) -> int:
    """Reads the flow collection at ``at`` and returns the offset behind it; one left open ends at ``limit``."""
    stack: list[tuple[str, list[str]]] = []
    key: str | None = None
    while True:
        at = _FLOW_SPACE.match(text, at).end()
        if at >= limit:
            return limit
        c = text[at]
        if c in "[{":
            own = [*(stack[-1][1] if stack else path), *([key] if key is not None else [])]
            stack.append((c, own))
            key, at = None, at + 1
        elif c in "]}":
            if stack:
                stack.pop()
            key, at = None, at + 1
            if not stack:
                return at
        elif c == ",":
            key, at = None, at + 1
        elif c == ":":
            at += 1
        else:
            q = _QUOTED.match(text, at) if c in "\"'" else None
            m = q or _FLOW_PLAIN.match(text, at)
            if not m:
                at += 1
                continue
            g = (1 if q.group(1) is not None else 2) if q else 0
            low, high, at = m.start(g), m.end(g), m.end()
            behind = _FLOW_SPACE.match(text, at).end()
            if key is None and stack and stack[-1][0] == "{" and text[behind : behind + 1] == ":":
                key, at = text[low:high], behind + 1
            elif high > low:
                own = stack[-1][1] if stack else path
                out.append(([*own, key] if key is not None else own, low, high))


def yaml_pairs(text: str) -> Iterator[Pair]:
    """Block mappings and sequences by indentation, flow collections, quoted scalars over several lines, and the lines of
    block scalars: each under the key of its scalar, and pairs within them under their own keys too."""
    stack: list[tuple[int, str]] = []
    lines = [(m.start(), m.group()) for m in re.finditer(r"[^\n]+|(?<=\n)(?=\n)", text)]
    i = 0
    while i < len(lines):
        start, line = lines[i]
        i += 1
        bare = line.rstrip("\r")
        at = len(bare) - len(bare.lstrip(" "))
        if not bare.strip() or bare[at] == "#":
            continue
        outer = at
        dashed = False
        while bare[at : at + 1] == "-" and bare[at + 1 : at + 2] in (" ", "\t", ""):
            dashed = True
            outer = at
            at += 1
            at += len(bare[at:]) - len(bare[at:].lstrip(" \t"))
        m = _YAML_KEY.match(bare, at)
        if m:
            while stack and stack[-1][0] >= at:
                stack.pop()
            stack.append((at, next(g for g in m.groups() if g is not None)))
            low = m.end()
        elif dashed:
            # an item belongs to the mapping's key that stands to its left, or right above in the same column
            while stack and stack[-1][0] > outer:
                stack.pop()
            low = at
        else:
            continue
        low = _YAML_PROPERTY.match(bare, low).end()
        path, value = [k for _, k in stack], bare[low:]
        if not value or value[0] == "#":
            continue
        if value[0] in "[{":
            out: list[Pair] = []
            # a line that is not indented deeper than the key goes on with the mapping, unless it closes the collection
            nexts = (a for a, body in (lines[k] for k in range(i, len(lines))) if body.strip() and len(body) - len(body.lstrip(" ")) <= (at if m else outer) and body.lstrip()[0] not in "]}")
            end = _flow(text, start + low, next(nexts, len(text)), path, out)
            yield from out
            while i < len(lines) and lines[i][0] < end:
                i += 1
        elif _YAML_BLOCK.match(value):
            first = i
            while i < len(lines) and (not lines[i][1].strip() or len(lines[i][1]) - len(lines[i][1].lstrip(" ")) > (at if m else outer)):
                i += 1
            for at_line, body in lines[first:i]:
                shown = body.strip()
                if shown:
                    begin = at_line + len(body) - len(body.lstrip())
                    pairs = list(_line_pairs(text, begin, begin + len(shown)))
                    yield from (([*path, *keys], a, b) for keys, a, b in pairs)
                    if not pairs:
                        yield path, begin, begin + len(shown)
        else:
            q = _QUOTED.match(text, start + low)
            if q:
                g = 1 if q.group(1) is not None else 2
                yield path, q.start(g), q.end(g)
                while i < len(lines) and lines[i][0] < q.end():
                    i += 1
            else:
                value = re.split(r"\s+#", value)[0].rstrip()
                yield path, start + low, start + low + len(value)


# ---- INI, environment and registry files

_INI_LINE = re.compile(r"^[ \t]*(?:[#;][ \t]*)?(?:export[ \t]+|set[ \t]+)?([^\s=#;\[][^=\n]*?)[ \t]*=[ \t]*(.*?)[ \t\r]*$", re.M)
_INI_COLON = re.compile(r"^[ \t]*([\w.\-]+)[ \t]*:[ \t]+(.*?)[ \t\r]*$", re.M)
_SECTION = re.compile(r"^\s*\[([^\]\n]+)\]", re.M)


def _unquoted(value: str, low: int, comment: str) -> tuple[int, int]:
    q = _QUOTED.match(value)
    if q:
        g = 1 if q.group(1) is not None else 2
        return low + q.start(g), low + q.end(g)
    value = re.split(comment, value)[0].rstrip()
    return low, low + len(value)


def _line_pairs(text: str, low: int, high: int) -> Iterator[Pair]:
    """The pair that one line of text holds, if it does."""
    line = text[low:high]
    m = _INI_LINE.match(line) or _INI_COLON.match(line)
    if m and re.fullmatch(r"[\w.\-]+", m.group(1)):
        yield [m.group(1)], *_unquoted(m.group(2), low + m.start(2), r"\s+[#;]")


def ini_pairs(text: str) -> Iterator[Pair]:
    """One pair per line, under the last section. A commented-out pair counts."""
    sections = [(m.start(), m.group(1)) for m in _SECTION.finditer(text)]
    for pattern in (_INI_LINE, _INI_COLON):
        k = 0
        for m in pattern.finditer(text):
            if pattern is _INI_COLON and "=" in m.group():
                continue
            while k < len(sections) and sections[k][0] < m.start():
                k += 1
            section = [sections[k - 1][1]] if k else []
            low, high = _unquoted(m.group(2), m.start(2), r"\s+[#;]")
            key = re.split(r"[/:]", m.group(1))[-1] or m.group(1)
            yield [*section, key], low, high


# ---- TOML

_TOML_HEAD = re.compile(r"[ \t]*\[{1,2}([^\]\n]+)\]{1,2}")
_TOML_KEY = re.compile(r"[ \t]*((?:[\w\-]+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*')(?:[ \t]*\.[ \t]*(?:[\w\-]+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*'))*)[ \t]*=[ \t]*")
_TOML_STRING = re.compile(r"\"\"\"\n?([\s\S]*?)\"\"\"|'''\n?([\s\S]*?)'''|\"((?:[^\"\\\n]|\\.)*)\"|'([^'\n]*)'")
_TOML_BARE = re.compile(r"[^\s,\[\]{}#]+")
_TOML_PART = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'([^'\n]*)'|([\w\-]+)")


def _toml_keys(key: str) -> list[str]:
    return [next(g for g in m.groups() if g is not None) for m in _TOML_PART.finditer(key)]


def _toml_value(text: str, at: int, path: list[str], out: list[Pair]) -> int:
    """Reads the value at ``at``: a string, an array, an inline table or something bare; returns the offset behind it."""
    stack: list[list[str]] = []
    while at < len(text):
        at = _FLOW_SPACE.match(text, at).end() if stack else at
        c = text[at : at + 1]
        now = stack[-1] if stack else path
        if c == "[" or c == "{":
            stack.append(now)
            at += 1
        elif c in ("]", "}") and stack:
            stack.pop()
            at += 1
        elif c == "," and stack:
            stack[-1] = stack[-2] if len(stack) > 1 else path
            at += 1
        elif stack and (m := _TOML_KEY.match(text, at)):
            stack[-1] = [*(stack[-2] if len(stack) > 1 else path), *_toml_keys(m.group(1))]
            at = m.end()
        elif m := _TOML_STRING.match(text, at):
            out.append((now, m.start(m.lastindex), m.end(m.lastindex)))
            at = m.end()
        elif m := _TOML_BARE.match(text, at):
            out.append((now, m.start(), m.end()))
            at = m.end()
        else:
            at += 1
        if not stack:
            return at
    return at


def toml_pairs(text: str) -> Iterator[Pair]:
    head: list[str] = []
    at = 0
    while at < len(text):
        if m := _TOML_HEAD.match(text, at):
            head, at = _toml_keys(m.group(1)), m.end()
        elif m := _TOML_KEY.match(text, at):
            out: list[Pair] = []
            at = _toml_value(text, m.end(), [*head, *_toml_keys(m.group(1))], out)
            yield from out
        end = text.find("\n", at)
        at = len(text) if end < 0 else end + 1


# ---- XML

_XML_TOKEN = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<!\[CDATA\[([\s\S]*?)(?:\]\]>|\Z)|<[?!][^>]*>|</\s*([\w:.\-]+)\s*>|<([\w:.\-]+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>|([^<]+)")
_XML_ATTRIBUTE = re.compile(r"([\w:.\-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
#: Attributes and elements whose value names the value beside it. Fixed values.
_XML_NAMING = ("key", "name", "id", "property")


def xml_pairs(text: str) -> Iterator[Pair]:
    """Texts of elements under their element's path and attributes under theirs. A value attribute beside one that names
    it (``<add key="password" value="..."/>``) goes by that name, as does the text of such an element, and the text of a
    plist's value goes by the ``<key>`` before it."""
    path: list[str] = []
    label = ""
    for m in _XML_TOKEN.finditer(text):
        if m.group(3):
            attributes = {a.group(1).lower(): a for a in _XML_ATTRIBUTE.finditer(text, m.start(4), m.end(4))}
            naming = next((attributes[n] for n in _XML_NAMING if n in attributes), None)
            named = [naming.group(2) or naming.group(3) or ""] if naming else []
            for name, a in attributes.items():
                g = 2 if a.group(2) is not None else 3
                yield [*path, m.group(3), *(named if name == "value" and named else [name])], a.start(g), a.end(g)
            if not m.group(5):
                path.append(named[0] if named and named[0] else m.group(3))
        elif m.group(2):
            if path:
                path.pop()
        else:
            g = 1 if m.group(1) is not None else 6 if m.group(6) is not None else 0
            shown = m.group(g).strip() if g else ""
            if shown:
                low = m.start(g) + len(m.group(g)) - len(m.group(g).lstrip())
                if path and path[-1] == "key":
                    label = shown
                else:
                    plist = path and path[-1] in ("string", "data")
                    yield [*path, label] if plist and label else list(path), low, low + len(shown)
                    label = "" if plist else label


def pairs_of(text: str, path: str) -> Iterator[Pair]:
    """The reader that the file's name asks for; what is no known format is read line by line."""
    name = path.rsplit("/", 1)[-1].lower()
    for endings, reader in (((".json", ".json5", ".jsonc"), json_pairs), ((".yml", ".yaml"), yaml_pairs), ((".toml",), toml_pairs), ((".xml", ".config", ".plist", ".xsd", ".csproj", ".props"), xml_pairs)):
        if name.endswith(endings):
            return reader(text)
    return ini_pairs(text)
