"""Which paths discovery leaves out, and why: default folders, ignore files, and configured patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Folders that are left out when they are the first part of a path. Fixed values.
DEFAULT_FOLDERS = frozenset(".git .hg .svn .idea .vscode build cache coverage dist generated node_modules target tmp vendor".split())
SCRIPT_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
TEXT_EXTENSIONS = ("conf", "config", "env", "ini", "json", "toml", "xml", "yaml", "yml")
TEXT_NAMES = (".npmrc", ".pypirc", ".envrc", ".netrc")


def kind_of(path: str) -> str | None:
    """"script", "text", or nothing for a file that is not looked at."""
    name = path.rsplit("/", 1)[-1]
    extension = name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""
    if extension in SCRIPT_EXTENSIONS:
        return "script"
    if extension in TEXT_EXTENSIONS or name.startswith(".env") or name in TEXT_NAMES:
        return "text"
    return None


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    expression: re.Pattern
    negated: bool
    folders_only: bool


def _translate(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
            continue
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out += "/.*"
            i += 3
            continue
        if glob.startswith("**", i):
            out += ".*"
            i += 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                out += r"\["
            else:
                body = glob[i + 1 : end]
                out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
                i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def parse_ignore_file(text: str, folder: str = "") -> list[IgnoreRule]:
    """Rules of an ignore file in ``folder``; blank lines and comments are none."""
    rules = []
    for raw in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", raw)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else re.sub(r"^\\([!#])", r"\1", line)
        folders_only = line.endswith("/")
        glob = line.strip("/") if folders_only else line.lstrip("/") if line.startswith("/") else line
        anchored = line.startswith("/") or "/" in line.rstrip("/")
        prefix = re.escape(folder + "/") if folder else ""
        rules.append(IgnoreRule(raw.strip(), re.compile(prefix + ("" if anchored else "(?:.*/)?") + _translate(glob) + r"\Z"), negated, folders_only))
    return rules


def ignored_by(rules: list[IgnoreRule], path: str) -> str | None:
    """The pattern that leaves a file out; of all that match a path or a folder above it the last holds, but nothing
    within a folder that is left out comes back."""
    parts = path.split("/")
    for i in range(1, len(parts) + 1):
        at, is_folder = "/".join(parts[:i]), i < len(parts)
        last = None
        for rule in rules:
            if (is_folder or not rule.folders_only) and rule.expression.match(at):
                last = rule
        if last is not None and not last.negated:
            return last.pattern
    return None


def configured(patterns: tuple[str, ...], path: str) -> str | None:
    """Configured patterns match a path exactly, as a folder in front of it, or as a glob."""
    for p in patterns:
        bare = p.rstrip("/")
        if path == bare or path.startswith(bare.removesuffix("/**") + "/") and ("*" not in bare or bare.endswith("/**")):
            return p
        if "*" in p and re.match(_translate(p) + r"\Z", path):
            return p
    return None


def classify(path: str, rules: list[IgnoreRule] = (), patterns: tuple[str, ...] = (), explicit: bool = False) -> tuple[str, str] | None:
    """(source, pattern) of what leaves a path out: a default folder, an ignore file, or the configuration. A path that
    was asked for by name is left out by default folders and the configuration only."""
    first = path.split("/")[0]
    if "/" in path and first in DEFAULT_FOLDERS:
        return "default", first + "/"
    if not explicit and (hit := ignored_by(list(rules), path)):
        return "gitignore", hit
    if hit := configured(tuple(patterns), path):
        return "config", hit
    return None
