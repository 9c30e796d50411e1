"""Configuration files: JSON, and the subset of YAML that they use; checked, and resolved to a :class:`Config`."""

from __future__ import annotations

import json
import os
import re

from sievework.operators.catalog import PROFILES, RULES, Config, ConfigError, config_of

VERSION = "sievework.config.v1"
NAMES = ("sievework.yaml", "sievework.yml", ".sievework.yaml", "sievework.json")
#: Commands that fail from a severity on.
GATED = ("analyse", "summary", "report")
LISTS = ("accepted_abbreviations", "banned_generic_names", "accepted_boolean_names", "boolean_prefixes", "hungarian_prefixes", "placeholder_names", "negative_boolean_allowed", "known_acronyms", "secret_previews")


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and len(text) > 1 and text[-1] == text[0]:
        return json.loads(text) if text[0] == '"' else text[1:-1].replace("''", "'")
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(p) for p in re.findall(r"\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^,\[\]]+", text[1:-1]) if p.strip()]
    if text == "{}":
        return {}
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d+\.\d+", text):
        return float(text)
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text, text)


def parse_yaml(text: str):
    """Mappings, sequences, inline lists, quoted and plain scalars and comments. Tabs and indentation that fits nowhere
    raise, and so does what the subset lacks (anchors, block scalars, inline maps with content)."""
    lines = []
    for n, raw in enumerate(text.lstrip("﻿").splitlines(), 1):
        bare = re.sub(r"(?:^|\s)#.*$", "", raw) if not re.search(r"[\"'].*#.*[\"']", raw) else raw
        if bare.strip():
            if "\t" in bare[: len(bare) - len(bare.lstrip())]:
                raise ConfigError(f"line {n}: a tab indents")
            if re.search(r":\s+(?:[&*]\S|[|>])|:\s*\{.+\}", bare):
                raise ConfigError(f"line {n}: not supported here: {bare.strip()}")
            lines.append((n, len(bare) - len(bare.lstrip(" ")), bare.strip()))
    at = 0

    def node(indent: int):
        nonlocal at
        return sequence(indent) if lines[at][2].startswith("- ") or lines[at][2] == "-" else mapping(indent)

    def below(indent: int):
        if at < len(lines) and lines[at][1] > indent:
            return node(lines[at][1])
        return None

    def sequence(indent: int) -> list:
        nonlocal at
        out = []
        while at < len(lines) and lines[at][1] == indent and lines[at][2][0] == "-":
            rest = lines[at][2][1:].strip()
            at += 1
            out.append(_scalar(rest) if rest else below(indent))
        check(indent)
        return out

    def mapping(indent: int) -> dict:
        nonlocal at
        out: dict = {}
        while at < len(lines) and lines[at][1] == indent:
            n, _, body = lines[at]
            m = re.match(r"(\"[^\"]*\"|'[^']*'|[^\s:][^:]*?)\s*:(?:\s+(.*))?$", body)
            if not m:
                raise ConfigError(f"line {n}: expected a key: {body}")
            key = str(_scalar(m.group(1)))
            if key in out:
                raise ConfigError(f"line {n}: {key!r} is given twice")
            at += 1
            if m.group(2):
                out[key] = _scalar(m.group(2))
            elif at < len(lines) and lines[at][1] == indent and lines[at][2].startswith("- "):
                out[key] = sequence(indent)
            else:
                out[key] = below(indent)
        check(indent)
        return out

    def check(indent: int) -> None:
        if at < len(lines) and lines[at][1] > indent:
            raise ConfigError(f"line {lines[at][0]}: unexpected indentation")

    if not lines:
        return {}
    value = node(lines[0][1])
    if at < len(lines):
        raise ConfigError(f"line {lines[at][0]}: unexpected indentation")
    return value


def validated(data: object) -> dict:
    """A configuration as overrides for :func:`config_of`; what is wrong raises."""
    if not isinstance(data, dict):
        raise ConfigError("a configuration is a mapping")
    if data.get("schemaVersion") != VERSION:
        raise ConfigError(f"schemaVersion has to be {VERSION!r}")
    out: dict = {"thresholds": {}, "options": {}, "severities": {}, "disabled": set(), "named": set(data.get("rules") or {}), "minimum_severity": {}}
    for command, severity in (data.get("minimumSeverity") or {}).items():
        if command not in GATED:
            raise ConfigError(f"unknown command {command!r} in minimumSeverity; known are {', '.join(GATED)}")
        if severity not in ("none", "advisory", "warning", "error"):
            raise ConfigError(f"unknown severity {severity!r}")
        out["minimum_severity"][command] = severity
    for rule_id, options in (data.get("rules") or {}).items():
        if rule_id not in RULES:
            near = [r for r in RULES if r.split(".")[-1] == rule_id.split(".")[-1]]
            raise ConfigError(f"unknown rule {rule_id!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        options = options or {}
        if options.get("enabled") is False:
            out["disabled"].add(rule_id)
        if "threshold" in options:
            if isinstance(options["threshold"], bool) or not isinstance(options["threshold"], (int, float)):
                raise ConfigError(f"the threshold of {rule_id} is no number")
            out["thresholds"][rule_id] = float(options["threshold"])
        for name, value in (options.get("options") or {}).items():
            if name not in RULES[rule_id].option_keys or isinstance(value, bool) or not isinstance(value, (int, float)):
                raise ConfigError(f"{name!r} is no option of {rule_id}, or no number")
            out["options"].setdefault(rule_id, {})[name] = value
        if "severity" in options:
            if options["severity"] not in ("advisory", "warning", "error"):
                raise ConfigError(f"unknown severity {options['severity']!r}")
            out["severities"][rule_id] = options["severity"]
    for name in LISTS:
        if name in (data.get("names") or {}):
            out[name] = data["names"][name]
    out["ignored_paths"] = tuple((data.get("paths") or {}).get("ignore") or ())
    return out


def _read(at: str) -> dict:
    try:
        with open(at, encoding="utf-8-sig") as f:
            text = f.read()
        data = json.loads(text) if at.endswith(".json") else parse_yaml(text)
    except (ValueError, OSError) as x:
        raise ConfigError(f"{at}: {x}") from x
    if not isinstance(data, dict):
        raise ConfigError(f"{at}: a configuration is a mapping")
    return data


def profile_of(spec: str, folder: str = ".") -> tuple[str, dict[str, dict]]:
    """(name, profiles) of a profile that is named or that a file holds; a file may extend another by its path."""
    custom: dict[str, dict] = {}

    def from_file(path: str) -> str:
        name = os.path.abspath(path)
        if name not in custom:
            data = _read(name)
            own = validated({"schemaVersion": VERSION, "rules": data.get("rules")})
            custom[name] = {k: own[k] for k in ("thresholds", "options", "severities", "disabled")} | {"ignored_paths": tuple((data.get("paths") or {}).get("ignore") or ())}
            if base := data.get("extends"):
                custom[name]["extends"] = from_file(os.path.join(os.path.dirname(name), base)) if _is_path(base) else base
        return name

    return (from_file(os.path.join(folder, spec)), custom) if _is_path(spec) else (spec, custom)


def _is_path(spec: str) -> bool:
    return "/" in spec or spec.endswith((".yaml", ".yml", ".json"))


def load(root: str = ".", path: str | None = None, profile: str | None = None, skip: bool = False) -> Config:
    """The configuration at ``path``, or the first of the known names below ``root``, or the defaults (also with ``skip``). A
    profile that is asked for goes before that of the file."""
    at = path or (None if skip else next((p for n in NAMES if os.path.isfile(p := os.path.join(root, n))), None))
    data = _read(at) if at else {}
    spec, folder = (profile, ".") if profile else (data.get("profile") or "recommended", os.path.dirname(at or ""))
    name, custom = profile_of(spec, folder)
    return config_of(name, validated(data) if at else None, (data.get("profiles") or {}) | custom)


def initial(profile: str = "recommended", ignored: tuple[str, ...] = (), minimum: dict[str, str] | None = None) -> str:
    """The text of a new configuration with every rule as the profile has it."""
    config = config_of(profile)
    lines = [f"schemaVersion: {VERSION}", f"profile: {profile}", "paths:", "  ignore:" + ("" if ignored else " []"), *[f'    - "{p}"' for p in ignored], *(["minimumSeverity:", *[f"  {c}: {v}" for c, v in minimum.items()]] if minimum else []), "rules:"]
    for r in sorted(RULES.values(), key=lambda r: r.rule_id):
        lines += [f"  {r.rule_id}:", f"    enabled: {str(config.enabled(r.rule_id)).lower()}"]
        if r.threshold is not None:
            lines.append(f"    threshold: {config.threshold(r.rule_id):g}")
    return "\n".join(lines) + "\n"


def profiles() -> list[dict]:
    """The presets with how many rules each leaves on."""
    return [{"profile": name, "enabled": len(RULES) - len(config_of(name).disabled), "total": len(RULES), "thresholds": len(spec.get("thresholds", {}))} for name, spec in PROFILES.items()]
