"""Rules on manifests, compiler settings and workflows: one parsed file at a time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from sievework.operators.catalog import Config
from sievework.operators.rules.perfile import Raw

# What downloads and runs, what is no version of a registry, scripts that run by themselves, rights to write.
_SHELL = re.compile(r"\b(?:curl|wget)\b[^\n|;&]*https?://[^\n|;&]*\|\s*(?:sudo\s+)?(?:sh|bash|zsh)\b", re.I)
_URL_SPEC = re.compile(r"^(?:https?://|git(?:\+https?|\+ssh)?://|ssh://|github:|gitlab:|bitbucket:|file:|git@[^:]+:[^/]+/|[\w.-]+/[\w.-]+(?:#.+)?$)", re.I)
_LIFECYCLE = ("preinstall", "install", "postinstall", "prepare", "prepublish", "prepublishOnly")
_WRITE_SCOPES = frozenset("actions checks contents deployments issues packages pull-requests repository-projects security-events statuses".split())
_JSONC = re.compile(r'"(?:[^"\\\n]|\\.)*"|//[^\n]*|/\*[\s\S]*?\*/|,(?=(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*[}\]])')


def parse_json(text: str) -> dict | None:
    """An object of JSON text, also with comments and trailing commas; None for anything else."""
    text = _JSONC.sub(lambda m: m.group() if m.group()[0] == '"' else " ", text.lstrip("﻿"))
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def key_line(text: str, key: str) -> int:
    m = re.search(rf'"{re.escape(key)}"\s*:', text)
    return text.count("\n", 0, m.start()) + 1 if m else 1


def _entries(value: object) -> list[tuple[str, str]]:
    return [(k, v) for k, v in value.items() if isinstance(v, str)] if isinstance(value, dict) else []


def bins(text: str) -> list[tuple[str, str, int]]:
    """(name, target, line) of a manifest's executables."""
    data = parse_json(text) or {}
    found = data.get("bin")
    pairs = [(str(data.get("name", "bin")), found)] if isinstance(found, str) else _entries(found)
    return [(k, v, key_line(text, k)) for k, v in pairs]


def package_findings(text: str) -> Iterator[Raw]:
    data = parse_json(text) or {}
    for name, command in _entries(data.get("scripts")):
        if _SHELL.search(command):
            yield Raw("security.remote-install-script", key_line(text, name), "A script runs what it downloads.", name)
        if name in _LIFECYCLE:
            yield Raw("security.risky-lifecycle-script", key_line(text, name), "A script runs at installation.", name)
    for section in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies"):
        for name, spec in _entries(data.get(section)):
            if _URL_SPEC.match(spec):
                yield Raw("security.url-dependency", key_line(text, name), "A dependency comes from a URL.", name)
            plain = spec.strip().lower()
            if section in ("dependencies", "optionalDependencies") and (plain in ("*", "x", "latest") or re.match(r">=\s*\d", plain) and "<" not in plain or "||" in plain):
                yield Raw("waste.broad-runtime-version", key_line(text, name), "A dependency may have any version.", name)


def tsconfig_findings(text: str) -> Iterator[Raw]:
    data = parse_json(text)
    if data is None:
        return
    options = data.get("compilerOptions")
    options = options if isinstance(options, dict) else {}
    for flag, rule_id in (("strict", "modernisation.tsconfig-strict-disabled"), ("noUncheckedIndexedAccess", "modernisation.tsconfig-index-safety-disabled"), ("exactOptionalPropertyTypes", "modernisation.tsconfig-exact-optional-disabled")):
        if options.get(flag) is True or flag not in options and "extends" in data:
            continue
        yield Raw(rule_id, key_line(text, flag), f"{flag} is not switched on.", flag)


def _commands(lines: list[tuple[int, int, str, bool]]) -> Iterator[tuple[int, str]]:
    """(line, text) of the steps' commands; a block scalar goes on as far as lines are indented deeper."""
    block: tuple[int, int, list[str]] | None = None
    for n, indent, text, empty in lines:
        if block and indent <= block[1]:
            yield block[0], "\n".join(block[2])
            block = None
        if block:
            block[2].append(text)
        elif not empty and (m := re.match(r"(?:-\s*)?run:\s*(.*)$", text, re.I)):
            if re.fullmatch(r"[|>](?:[+-]?\d*|\d*[+-]?)?\s*", m.group(1)):
                block = (n, indent, [])
            else:
                yield n, m.group(1)
    if block:
        yield block[0], "\n".join(block[2])


def workflow_findings(text: str) -> Iterator[Raw]:
    lines = []
    for n, raw in enumerate(re.split(r"\r?\n", text), 1):
        bare = raw.partition(" #")[0].strip()
        lines.append((n, len(raw) - len(raw.lstrip(" ")), bare, not bare or bare.startswith("#")))
    shown = [(n, indent, bare) for n, indent, bare, empty in lines if not empty]
    contexts: set[str] = set()
    permissions: int | None = None
    for n, indent, bare in shown:
        if permissions is not None and indent <= permissions:
            permissions = None
        scoped = re.match(r"([a-z-]+):\s*write\b", bare, re.I)
        scope = "write-all" if re.match(r"permissions:\s*write-all\b", bare, re.I) else scoped.group(1) if scoped and scoped.group(1) in _WRITE_SCOPES else None
        if re.match(r"permissions:\s*$", bare, re.I):
            permissions = indent
        elif scope and (scope == "write-all" or permissions is not None):
            yield Raw("security.github-actions-broad-permissions", n, f"The workflow may write: {scope}.", scope)
        used = re.match(r"(?:-\s*)?uses:\s*[\"']?([^@\s\"'#]+)@([^ \t\"'#]+)", bare, re.I)
        if used and "/" in used.group(1) and not used.group(1).startswith("./") and used.group(1).split("/")[0] not in ("actions", "github") and not re.fullmatch(r"[0-9a-f]{40}", used.group(2), re.I):
            yield Raw("security.github-actions-unpinned-action", n, f"The action {used.group(1)} is not pinned to a commit.", used.group(1))
        for context, there in (("checkout", re.match(r"(?:-\s*)?uses:\s*[\"']?actions/checkout@", bare, re.I)), ("run", re.match(r"(?:-\s*)?run:\s*", bare, re.I)), ("secrets", re.search(r"\bsecrets\.", bare)), ("write-permissions", scope)):
            if there:
                contexts.add(context)
    for n, command in _commands(lines):
        if re.search(r"\b(?:curl|wget)\b[^|]*https?://[^|]*\|\s*(?:sudo\s+)?(?:sh|bash|zsh)\b", command, re.I):
            yield Raw("security.github-actions-remote-shell", n, "A step runs what it downloads.", "run")
    target = next((n for n, _, bare in shown if re.search(r"\bpull_request_target\b", bare)), None)
    if target and contexts:
        yield Raw("security.github-actions-pull-request-target", target, "Outside changes run with rights.", "pull_request_target", metadata={"contexts": sorted(contexts)})
    if any(re.search(r"\bpull_request(?:_target)?\b", bare) for _, _, bare in shown):
        for n, _, bare in shown:
            if m := re.search(r"\bsecrets\.([A-Za-z_][A-Za-z0-9_]*)\b", bare):
                yield Raw("security.github-actions-secrets-in-pr", n, f"The secret {m.group(1)} is used for outside changes.", m.group(1))


def service_account(text: str, config: Config) -> Iterator[Raw]:
    """A service account's key, in a file of any kind: its type stands beside a private key."""
    kind = re.search(r'"type"\s*:\s*"service_account"', text)
    if kind and re.search(r'"private_key"\s*:\s*"|BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY', text):
        named = re.search(r'"private_key_id"\s*:\s*"([^"]+)"', text) or re.search(r'"client_email"\s*:\s*"([^"]+)"', text)
        preview = redacted(named.group(1) if named else "service_account")
        if preview not in config.secret_previews:
            yield Raw("sensitive-data.gcp-service-account-key", text.count("\n", 0, kind.start()) + 1, f"A service account's key is stored: {preview}", metadata={"preview": preview})


def redacted(value: str) -> str:
    """The preview of a secret, as the column expression gives it."""
    shown = "*" * len(value) if len(value) <= 8 else f"{value[:4]}...{value[-4:]}"
    return f"{shown} (redacted, {len(value)} chars)"


def manifest_findings(path: str, text: str, config: Config) -> list[dict]:
    """Findings of a file by its name, and of any file that stores a service account's key."""
    name = path.rsplit("/", 1)[-1]
    found: list[Raw] = []
    if name == "package.json":
        found += package_findings(text)
    elif re.fullmatch(r"tsconfig(?:\.[^.]+)*\.json", name):
        found += tsconfig_findings(text)
    elif re.search(r"^\.github/workflows/[^/]+\.ya?ml$", path, re.I):
        found += workflow_findings(text)
    found += service_account(text, config)
    return [raw.row() for raw in found if config.enabled(raw.rule_id)]
